"""All registered queries: importing the modules registers them."""

from gateledger.plans import history, stored, texts
from gateledger.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "history", "stored", "texts"]
