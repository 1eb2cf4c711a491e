"""Text expressions whose results agree with JavaScript string semantics.

The event payloads come from a JavaScript service, so trimming strips every Unicode
space, lengths count UTF-16 units and falsy strings are empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What JavaScript calls white space. Java's \s is ASCII only; its Unicode form has U+0085, which
# JavaScript lacks, and lacks the byte-order mark.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    A column expression is a tree: naming it twice computes it twice. A lambda's argument is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_trim(col: Column) -> Column:
    return F.regexp_replace(col, rf"\A{SPACE}+|{SPACE}+\z", "")


def js_length(col: Column) -> Column:
    """Length in UTF-16 units (an emoji outside the basic plane counts two)."""
    return (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int")


def clip(col: Column, n: int) -> Column:
    """First ``n`` UTF-16 units. A surrogate pair cut in half is left out whole."""
    units = F.substring(F.encode(col, "UTF-16BE"), 1, 2 * n)
    last_unit = F.hex(F.substring(units, 2 * n - 1, 1))
    whole = F.when(
        last_unit.between("D8", "DB"), F.substring(units, 1, 2 * n - 2)
    ).otherwise(units)
    # At most n units long whenever it has at most n/2 code points: no need to encode.
    return F.when(F.length(col) * 2 <= n, col).otherwise(F.decode(whole, "UTF-16BE"))


def hash16(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, 16)


def decisions_hash(decisions: Column) -> Column:
    """Fingerprint of a decision list; a missing list hashes like an empty one."""
    return hash16(F.coalesce(F.to_json(decisions), F.lit("[]")))


def numbered(decisions: Column, sep: str, indent: str = "") -> Column:
    lines = F.transform(
        decisions,
        lambda d, i: F.concat(
            F.lit(indent),
            (i + 1).cast("string"),
            F.lit(". "),
            F.coalesce(d["concept"], F.lit("")),
            F.lit(": "),
            F.coalesce(d["summary"], F.lit("")),
        ),
    )
    return F.coalesce(F.array_join(lines, sep), F.lit(""))


def ground_truth(decisions: Column) -> Column:
    """The decision list as the numbered text a grader compares against."""
    return numbered(decisions, "\n\n")


def no_dash(col: Column) -> Column:
    """Em and en dashes become commas."""
    dashed = F.regexp_replace(col, rf"{SPACE}*[\x{{2014}}\x{{2013}}]{SPACE}*", ", ")
    return js_trim(F.replace(dashed, F.lit(" ,"), F.lit(",")))


def pick_index(seed: Column, n: int) -> Column:
    """Stable choice out of ``n`` variants: a 31-multiplier hash over UTF-16 units, mod 2^32."""
    modulus = F.lit(1 << 32)

    def step(h: Column, char: Column) -> Column:
        code = F.ascii(char).cast("bigint")
        above = code - 0x10000
        high = F.lit(0xD800).cast("bigint") + F.shiftright(above, 10)
        low = F.lit(0xDC00).cast("bigint") + above.bitwiseAND(F.lit(0x3FF))
        one = (h * 31 + code) % modulus
        two = (((h * 31 + high) % modulus) * 31 + low) % modulus
        return F.when(code > 0xFFFF, two).otherwise(one)

    chars = F.filter(F.split(F.coalesce(seed, F.lit("")), ""), lambda c: c != "")
    return (F.aggregate(chars, F.lit(0).cast("bigint"), step) % n).cast("int")


def humanize(concept: Column) -> Column:
    """A slug read as words."""
    spaced = F.regexp_replace(concept, "[-_]+", " ")
    return js_trim(F.regexp_replace(spaced, rf"{SPACE}+", " "))


def ask_for(decision: Column) -> Column:
    """The question put to a reviewer for one decision."""
    asked = F.nullif(js_trim(decision["question"]), F.lit(""))
    return F.coalesce(
        asked,
        F.concat(
            F.lit("the "),
            F.coalesce(humanize(decision["concept"]), F.lit("")),
            F.lit(": how it works and why"),
        ),
    )


def split_full_name(full_name: Column) -> Column:
    """``owner/repo`` as a struct; a missing part is null, a third part is ignored."""
    parts = F.split(full_name, "/")
    return F.struct(
        F.try_element_at(parts, F.lit(1)).alias("owner"),
        F.try_element_at(parts, F.lit(2)).alias("repo"),
    )
