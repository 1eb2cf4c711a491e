"""Queries over texts: paths, diffs, scalar expressions, scoring, overlap, closes."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from gateledger.functions import answers, replies, text
from gateledger.functions.diffs import GENERATED_RE, TRIVIAL_RE
from gateledger.operators import aggregates, filters, overlap, policy, scoring
from gateledger.plans.registry import Source, query
from gateledger.plans.sql import TRIM, classified, sql_pick
from gateledger.schemas import CLOSEOUT, DECISIONS

@query(
    f"""SELECT conv_id, turn FROM conversations WHERE role <> 'assistant' AND role = 'user' AND length({TRIM.format("text")}) >= 40"""
)
def eligible_comments(s: Source):
    association = F.when(F.col("role") == "system", "NONE").otherwise("MEMBER")
    comments = s.conversations.withColumns(
        {
            "is_pr": F.lit(True),
            "body": F.col("text"),
            "user_type": F.when(F.col("role") == "assistant", "Bot").otherwise("User"),
            "author_association": association,
        }
    )
    return filters.eligible_comments(comments).select("conv_id", "turn")


PATHS = """paths AS (SELECT page_id, regexp_extract(url, '://[^/]+/([^?#]*)', 1)
  || (['', '.md', '/dist/x.js', '.min.css', '/LICENSE-MIT', '.map', '/go.sum'])[page_id % 7 + 1] AS file FROM pages)"""


def paths(s: Source):
    endings = ["", ".md", "/dist/x.js", ".min.css", "/LICENSE-MIT", ".map", "/go.sum"]
    ending = F.element_at(F.array(*map(F.lit, endings)), (F.col("page_id") % 7 + 1).cast("int"))
    return s.pages.select(
        "page_id", F.concat(F.regexp_extract("url", "://[^/]+/([^?#]*)", 1), ending).alias("file")
    )


@query(
    f"""SELECT page_id, regexp_matches(file, '{TRIVIAL_RE}') AS is_trivial, regexp_matches(file, '{GENERATED_RE}') AS is_generated FROM paths""",
    (PATHS,),
)
def path_flags(s: Source):
    return filters.path_flags(paths(s)).select("page_id", "is_trivial", "is_generated")


DIFFS = """diffs AS (SELECT doc_id, lang,
    CASE WHEN doc_id % 5 = 0 THEN ['docs/' || source] WHEN doc_id % 5 = 1 THEN CAST([] AS VARCHAR[]) ELSE ['src/' || source || '.py', 'README.md'] END AS files,
    array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: (['+', '-', ' '])[(i - 1) % 3 + 1] || l), chr(10)) AS diff
  FROM documents)"""


def diffs(s: Source):
    signs = F.array(F.lit("+"), F.lit("-"), F.lit(" "))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.element_at(signs, i % 3 + 1), line))
    return s.documents.select(
        "doc_id",
        "lang",
        F.when(F.col("doc_id") % 5 == 0, F.array(F.concat(F.lit("docs/"), "source")))
        .when(F.col("doc_id") % 5 == 1, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("src/"), F.col("source"), F.lit(".py")), F.lit("README.md")))
        .alias("files"),
        F.array_join(lines, "\n").alias("diff"),
    )


@query(
    """SELECT doc_id,
      CAST(len(list_filter(string_split(diff, chr(10)), lambda l: starts_with(l, '+') AND NOT starts_with(l, '+++'))) AS INTEGER) AS added,
      CAST(len(list_filter(string_split(diff, chr(10)), lambda l: starts_with(l, '-') AND NOT starts_with(l, '---'))) AS INTEGER) AS removed FROM diffs""",
    (DIFFS,),
)
def changed_lines(s: Source):
    return filters.changed_lines(diffs(s)).select("doc_id", "added", "removed")


@query("SELECT doc_id, trivial, reason FROM classified", (DIFFS, classified("diffs")))
def classify_prs(s: Source):
    return filters.classify_prs(diffs(s)).select("doc_id", "trivial", "reason")


@query(
    """SELECT doc_id, len(list_filter(files, lambda f: regexp_matches(f, '\\A(src/.*)\\z') AND NOT regexp_matches(f, '\\A(src/src[^/]*7\\.py)\\z'))) > 0 AS gate_by_path FROM diffs""",
    (DIFFS,),
)
def path_policy(s: Source):
    return policy.path_policy(diffs(s), ["src/**"], ["src/src*7.py"]).select("doc_id", "gate_by_path")


@query(
    """SELECT doc_id, CASE WHEN len(list_filter(files, lambda f: regexp_matches(f, '\\A(src/src1[^/]*\\.py)\\z'))) > 0 THEN 'harsh' ELSE 'medium' END AS rigor FROM diffs""",
    (DIFFS,),
)
def path_rigor(s: Source):
    return policy.path_rigor(diffs(s), ["src/src1*.py"]).select("doc_id", "rigor")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def hash16(s: Source):
    return s.documents.select("doc_id", text.hash16(F.col("text")).alias("hash"))


def decided(s: Source):
    """Documents with two decisions each, one of them with a question now and then."""

    def one(concept, summary, question):
        return F.struct(concept.alias("concept"), summary.alias("summary"), question.alias("question"))

    none = F.lit(None).cast("string")
    question = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" why "), "source", F.lit("? ")))
    both = F.array(
        one(F.col("source"), F.concat(F.lit("kept in "), "lang"), question),
        one(F.concat(F.lit("set-of__"), "lang"), F.lit("the of and with by"), none),
    )
    empty = F.array().cast(DECISIONS)
    return s.documents.withColumn("decisions", F.when(F.col("doc_id") % 7 == 0, empty).otherwise(both.cast(DECISIONS)))


@query(
    """SELECT doc_id, substr(sha256(CASE WHEN doc_id % 7 = 0 THEN '[]' ELSE '[{"concept":"' || source || '","summary":"kept in ' || lang || '"'
      || CASE WHEN doc_id % 3 = 0 THEN ',"question":" why ' || source || '? "' ELSE '' END
      || '},{"concept":"set-of__' || lang || '","summary":"the of and with by"}]' END), 1, 16) AS hash FROM documents"""
)
def decisions_hash(s: Source):
    return decided(s).select("doc_id", text.decisions_hash(F.col("decisions")).alias("hash"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE '1. ' || source || ': kept in ' || lang || chr(10) || chr(10)
      || '2. set-of__' || lang || ': the of and with by' END AS truth FROM documents"""
)
def ground_truth(s: Source):
    return decided(s).select("doc_id", text.ground_truth(F.col("decisions")).alias("truth"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'why ' || source || '?' ELSE 'the ' || source || ': how it works and why' END AS ask,
      CASE WHEN doc_id % 7 <> 0 THEN 'the set of ' || lang || ': how it works and why' END AS ask_second FROM documents"""
)
def ask_for(s: Source):
    some = F.size("decisions") > 0  # documents without decisions have nothing to ask
    return decided(s).select(
        "doc_id",
        F.when(some, text.ask_for(F.get("decisions", F.lit(0)))).alias("ask"),
        F.when(some, text.ask_for(F.get("decisions", F.lit(1)))).alias("ask_second"),
    )


CLOSE = """closes AS (SELECT doc_id, source, lang, doc_id % 6 IN (0, 1, 5) AS good,
  CASE lang WHEN 'en' THEN 'strong' WHEN 'fr' THEN 'thin' ELSE 'solid' END AS verdict, text FROM documents)"""


@query(
    """SELECT doc_id, good AS has_object, CASE WHEN good THEN text END AS strongest, CASE WHEN good THEN 1 WHEN doc_id % 6 = 4 THEN 1 END AS n_topics
    FROM closes""",
    (CLOSE,),
)
def extract_json(s: Source):
    parsed = answers.extract_json(F.col("raw"))
    rows = s.answers.select("doc_id", parsed.alias("v"))
    topics = F.try_variant_get("v", "$.topics", "array<variant>")
    return rows.select(
        "doc_id",
        (F.try_variant_get("v", "$.growth_edge", "string").isNotNull()).alias("has_object"),
        F.try_variant_get("v", "$.strongest", "string").alias("strongest"),
        F.when(F.size(topics) >= 0, F.size(topics)).alias("n_topics"),
    )


@query(
    """SELECT doc_id, source AS concept, verdict, substr(text, 1, 240) AS note, substr(text, 1, 400) AS strongest, lang AS growth_edge, 'ok' AS one_line
    FROM closes WHERE good""",
    (CLOSE,),
)
def normalise_closeout(s: Source):
    close = s.answers.select("doc_id", answers.normalise_closeout(F.col("raw")).alias("c"))
    return close.filter("c IS NOT NULL").select(
        "doc_id", F.col("c.topics")[0]["concept"].alias("concept"), F.col("c.topics")[0]["verdict"].alias("verdict"),
        F.col("c.topics")[0]["note"].alias("note"), "c.strongest", "c.growth_edge", "c.one_line",
    )


@query(
    """SELECT doc_id % 20 AS passed_by_id, source AS concept, count(*) FILTER (verdict = 'strong') AS strong,
      count(*) FILTER (verdict = 'solid') AS solid, count(*) FILTER (verdict = 'thin') AS thin FROM closes WHERE good GROUP BY 1, 2""",
    (CLOSE,),
)
def topic_record(s: Source):
    gates = s.answers.select(
        (F.col("doc_id") % 20).alias("passed_by_id"), answers.normalise_closeout(F.col("raw")).alias("closeout")
    )
    return aggregates.topic_record(gates)


@query(
    """SELECT doc_id, regexp_replace(replace(regexp_replace(replace(replace(text, '. ', ' — '), 'the', '–'), '[\\s\\x{00A0}]*[—–][\\s\\x{00A0}]*', ', ', 'g'), ' ,', ','),
      '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g') AS clean FROM documents"""
)
def no_dash(s: Source):
    dashed = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(" — ")), F.lit("the"), F.lit("–"))
    return s.documents.select("doc_id", text.no_dash(dashed).alias("clean"))


@query(
    """SELECT doc_id, CAST(list_reduce(list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT)),
      lambda h, x: (h * 31 + x) % 4294967296, CAST(0 AS BIGINT)) % 5 AS INTEGER) AS variant FROM documents"""
)
def pick_index(s: Source):
    return s.documents.select("doc_id", text.pick_index(F.col("text"), 5).alias("variant"))


@query(
    """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(translate(text, '.e', '-_'), '[-_]+', ' ', 'g'), '[\\s\\x{00A0}]+', ' ', 'g'), '^ | $', '', 'g') AS spoken
    FROM documents"""
)
def humanize(s: Source):
    return s.documents.select("doc_id", text.humanize(F.translate("text", ".e", "-_")).alias("spoken"))


@query(
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN string_split(path, '/')[1] ELSE path END AS owner,
      CASE WHEN page_id % 2 = 0 THEN string_split(path, '/')[2] END AS repo
    FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '://[^/]+/([^?#]*)', 1) ELSE regexp_extract(url, '://([^/]+)/', 1) END AS path FROM pages)"""
)
def split_full_name(s: Source):
    path = F.regexp_extract("url", "://[^/]+/([^?#]*)", 1)
    host = F.regexp_extract("url", "://([^/]+)/", 1)
    name = F.when(F.col("page_id") % 2 == 0, path).otherwise(host)
    return s.pages.select("page_id", text.split_full_name(name).alias("n")).select("page_id", "n.owner", "n.repo")


@query(
    """SELECT doc_id, '🌊' || substr(text, 1, 58) AS led, CASE WHEN length(text) <= 58 THEN text || '🌊' ELSE substr(text, 1, 59) END AS cut,
      substr(text, 1, 6000) AS long FROM documents"""
)
def clip(s: Source):
    wave = F.lit("🌊")
    return s.documents.select(
        "doc_id",
        text.clip(F.concat(wave, "text"), 60).alias("led"),
        text.clip(F.concat(F.substring("text", 1, 59), wave), 60).alias("cut"),
        text.clip(F.col("text"), 6000).alias("long"),
    )


WORDINGS = replies.Texts(
    openings=("What does this change do?", "How does this change work?", "Why is this change right?"),
    lead_ins=("Cover", "Say something about"),
    closings=("Reply here.", "Answer below.", "A reply will be graded."),
    rescue_heads=("### Not yet", "### One more point"),
)
NL = "chr(10) || chr(10)"
CONCEPT = "'part-' || lang"
ELICIT = f"""concat_ws({NL}, '### Explain this change to merge', {sql_pick(WORDINGS.openings, f"CASE WHEN doc_id % 4 = 0 THEN 'whole' ELSE {CONCEPT} || '|' || source END")},
  CASE WHEN doc_id % 4 <> 0 THEN {sql_pick(WORDINGS.lead_ins, f"({CONCEPT} || '|' || source || '^')")} || ':' || chr(10) || '- the part ' || lang || ': how it works and why'
    || chr(10) || '- why ' || doc_id || '?' END,
  {sql_pick(WORDINGS.closings, f"CASE WHEN doc_id % 4 = 0 THEN 'whole~' ELSE {CONCEPT} || '|' || source || '~' END")})"""


@query(
    f"""SELECT doc_id, '### Daily limit reached' || {NL} || 'Not gated: '
      || CASE WHEN doc_id % 2 = 0 THEN 'this account has used up its daily gates' ELSE 'the service has used up its daily gates' END
      || '. The check is neutral and does not block.' AS capped,
      '### Grader unavailable' || {NL} || 'No grade was given (' || source || ', ' || lang || '). The check is neutral, not passed.' AS ungraded,
      {ELICIT} AS elicit,
      concat_ws({NL}, {sql_pick(WORDINGS.rescue_heads, "(source || ' ' || doc_id)")}, source || ' ' || doc_id, 'Another reply here will be graded too.') AS rescue,
      CASE WHEN doc_id % 3 = 0 THEN concat_ws({NL}, '{replies.PASS_HEAD}', 'Thank you, @' || lang || '. Your reply explains the mechanism.')
        ELSE concat_ws({NL}, '{replies.PASS_HEAD}', concat_ws(' ', 'Thank you, @' || lang || '.', nullif(CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END, '')),
          '**Best explained:** ' || source, CASE WHEN doc_id % 7 <> 0 THEN '**Go deeper on:** ' || lang || ', ' || source END, 'This close is kept on your record.') END AS passed
    FROM documents"""
)
def comment_body(s: Source):
    """All five kinds, with and without decisions and closes."""
    scope = F.when(F.col("doc_id") % 2 == 0, "install").otherwise("global")
    note = F.concat("source", F.lit(" — "), "lang")

    def decision(concept: Column, question: Column) -> Column:
        return F.struct(concept.alias("concept"), F.lit("s").alias("summary"), question.alias("question"))

    none = F.lit(None).cast("string")
    two = F.array(
        decision(F.concat(F.lit("part-"), "lang"), none), decision(F.col("source"), F.concat(F.lit(" why "), F.col("doc_id"), F.lit("? ")))
    ).cast(DECISIONS)
    decisions = F.when(F.col("doc_id") % 4 == 0, F.array().cast(DECISIONS)).otherwise(two)
    close = F.struct(
        F.array().cast("array<struct<concept:string,verdict:string,note:string>>").alias("topics"),
        F.col("source").alias("strongest"),
        F.when(F.col("doc_id") % 7 != 0, F.concat("lang", F.lit(" – "), "source")).alias("growth_edge"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("one_line"),
    ).cast(CLOSEOUT)
    return s.documents.select(
        "doc_id",
        replies.comment_body("capped", scope=scope).alias("capped"),
        replies.comment_body("ungraded", note=note).alias("ungraded"),
        replies.elicit_body(decisions, WORDINGS).alias("elicit"),
        replies.rescue_body(F.concat_ws(" ", "source", "doc_id"), WORDINGS).alias("rescue"),
        replies.comment_body("pass", login=F.col("lang"), closeout=F.when(F.col("doc_id") % 3 != 0, close)).alias("passed"),
    )


# Offline model functions: what they answer follows from the text alone, so SQL can say it too.


def length_model():
    """Answers with the length of the text; fails on every seventh length."""

    def complete(system: str, user: str, model: str | None = None, timeout: float = 60.0) -> str:
        if len(user) % 7 == 0:
            raise TimeoutError("no answer in time")
        return "" if len(user) % 5 == 0 else f"{len(user)} characters"

    return complete


@query(
    """SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN NULL WHEN length(text) % 5 = 0 THEN '' ELSE length(text) || ' characters' END AS raw,
      CASE WHEN length(text) % 7 = 0 THEN 'no answer in time' END AS error FROM documents"""
)
def score_text(s: Source):
    scored = scoring.score_text(s.documents, length_model, F.lit("Count."), F.col("text"), calls_at_once=8)
    return scored.select("doc_id", "raw", "error")


def first_line_model():
    """Names the first line of a diff as its one decision; has nothing to say on even lengths."""

    def complete(system: str, user: str, model: str | None = None, timeout: float = 60.0) -> str:
        if len(user) % 2 == 0:
            return "I could not decide."
        lines = user.split("\n")
        return "```json\n" + json.dumps({"decisions": [{"concept": lines[0], "summary": str(len(lines))}]}) + "\n```"

    return complete


@query(
    """SELECT doc_id, length(diff) % 2 = 1 AS decompose_ok, CASE WHEN length(diff) % 2 = 1 THEN string_split(diff, chr(10))[1] END AS concept,
      CASE WHEN length(diff) % 2 = 1 THEN CAST(len(string_split(diff, chr(10))) AS VARCHAR) END AS summary FROM diffs""",
    (DIFFS,),
)
def decompose_batch(s: Source):
    rows = scoring.decompose_batch(diffs(s), first_line_model)
    first = F.get("decisions", F.lit(0))
    return rows.select(
        "doc_id", "decompose_ok", first["concept"].alias("concept"), first["summary"].alias("summary")
    )


def parity_model():
    """Passes explanations of even length, fails on lengths divisible by nine."""

    def complete(system: str, user: str, model: str | None = None, timeout: float = 60.0) -> str:
        told = user.split("\n\nExplanation:\n", 1)[1]
        if len(told) % 9 == 0:
            return '{"pass": "yes"}'
        return json.dumps({"pass": len(told) % 2 == 0, "covered": ["a"], "missing": [], "hole": system[-1:]})

    return complete


@query(
    """SELECT doc_id, length(text) % 9 <> 0 AND length(text) % 2 = 0 AS pass, length(text) % 9 = 0 AS ungraded,
      CASE WHEN length(text) % 9 = 0 THEN 'unreadable grade' END AS note, CAST(CASE WHEN length(text) % 9 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_covered FROM documents"""
)
def grade_batch(s: Source):
    requests = decided(s).select("doc_id", "decisions", F.col("text").alias("explanation"), F.lit("medium").alias("rigor"))
    graded = scoring.grade_batch(requests, parity_model)
    return graded.select(
        "doc_id", "grade.pass", "grade.ungraded", "grade.note", F.size("grade.covered").alias("n_covered")
    )


def closing_model():
    """Names the length of what it read; answers nonsense on every fourth length."""

    def complete(system: str, user: str, model: str | None = None, timeout: float = 60.0) -> str:
        if len(user) % 4 == 0:
            return "{nothing"
        topics = [{"concept": str(len(user)), "verdict": "strong" if timeout == 30 else "odd", "note": 7}]
        return json.dumps({"topics": topics, "strongest": user, "growth_edge": False, "one_line": None})

    return complete


@query(
    """SELECT doc_id, CAST(length(t) AS VARCHAR) AS concept, 'strong' AS verdict, '7' AS note, substr(t, 1, 400) AS strongest, '' AS growth_edge
    FROM (SELECT doc_id, substr(text, 1, 6000) AS t FROM documents) WHERE length(t) % 4 <> 0"""
)
def closeout_batch(s: Source):
    passed = decided(s).select("doc_id", "decisions", F.col("text").alias("explanation"))
    closed = scoring.closeout_batch(passed, closing_model).filter("closeout IS NOT NULL")
    topic = F.get("closeout.topics", F.lit(0))
    return closed.select(
        "doc_id", topic["concept"].alias("concept"), topic["verdict"].alias("verdict"), topic["note"].alias("note"),
        "closeout.strongest", "closeout.growth_edge",
    )


WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"
COVERAGE = f"""told AS (SELECT doc_id, source, lang, text, {WORDS.format("text")} AS w FROM documents WHERE doc_id % 7 <> 0),
covered AS (SELECT *, len(list_intersect({WORDS.format("'kept in ' || lang")}, w)) / len({WORDS.format("'kept in ' || lang")}) AS s1,
    len(list_intersect(['the', 'of', 'and', 'with', 'by'], w)) / 5 AS s2 FROM told)"""


@query(
    """SELECT doc_id, s1 >= 0.5 AND s2 >= 0.5 AS pass, CAST((s1 < 0.5)::INT + (s2 < 0.5)::INT AS INTEGER) AS n_missing,
      CASE WHEN s1 < 0.5 THEN CASE WHEN doc_id % 3 = 0 THEN 'why ' || source || '?' ELSE 'the ' || source || ': how it works and why' END
        WHEN s2 < 0.5 THEN 'the set of ' || lang || ': how it works and why' ELSE '' END AS hole FROM covered
    UNION ALL SELECT doc_id, false, 0, 'the change as a whole' FROM documents WHERE doc_id % 7 = 0""",
    (COVERAGE,),
)
def coverage_scorer(s: Source):
    requests = decided(s).withColumns({"explanation": F.col("text"), "rigor": F.lit("medium")})
    graded = scoring.coverage_scorer(requests)
    return graded.select("doc_id", "grade.pass", F.size("grade.missing").alias("n_missing"), "grade.hole")


@query(
    """SELECT rigor, count(*) FILTER (pass AND NOT expected) AS false_pass, count(*) FILTER (NOT pass AND expected) AS false_fail,
      count(*) AS total, count(*) FILTER (pass = expected) AS correct, CAST(round(count(*) FILTER (pass = expected) * 100.0 / count(*)) AS BIGINT) AS accuracy_pct
    FROM (SELECT 'medium' AS rigor, s1 >= 0.5 AND s2 >= 0.5 AS pass, quality = 1 AS expected FROM graded JOIN labels USING (doc_id)
      UNION ALL SELECT 'harsh', s1 >= 0.8 AND s2 >= 0.8, toxic = 1 FROM graded JOIN labels USING (doc_id)) GROUP BY 1""",
    (COVERAGE, "graded AS (SELECT doc_id, s1, s2 FROM covered UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE doc_id % 7 = 0)"),
)
def run_eval(s: Source):
    """Labelled documents as scenarios, graded at two rigors."""
    scenarios = (
        decided(s)
        .join(s.labels, "doc_id")
        .select(
            F.col("doc_id").cast("string").alias("name"),
            F.col("text").alias("explanation"),
            "decisions",
            F.array(F.lit("medium"), F.lit("harsh")).alias("rigors"),
            F.create_map(
                F.lit("medium"), F.col("quality") == 1, F.lit("harsh"), F.col("toxic") == 1
            ).alias("expected"),
        )
    )
    return scoring.run_eval(scenarios)


GRAMS = """list_distinct(list_transform(generate_series(1, len({0}) - 4), lambda i: array_to_string({0}[i:i + 4], ' ')))"""
TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _overlap_sql(extra: str = "") -> str:
    return f"""WITH tok AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents),
    grams AS (SELECT doc_id, CASE WHEN len(t) >= 5 THEN {GRAMS.format("t")} ELSE [] END AS g FROM tok),
    src AS (SELECT {TOKENS.format("text")} AS t FROM benchmark {extra}),
    known AS (SELECT DISTINCT unnest({GRAMS.format("t")}) AS gram FROM src WHERE len(t) >= 5),
    hits AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(g) AS gram FROM grams) JOIN known USING (gram) GROUP BY 1),
    shares AS (SELECT doc_id, CASE WHEN len(g) = 0 THEN 0.0 ELSE coalesce(n, 0) / CAST(len(g) AS DOUBLE) END AS share FROM grams LEFT JOIN hits USING (doc_id))
    SELECT doc_id, round(share, 6) AS overlap_share, CASE WHEN share >= 0.5 THEN 'high' WHEN share >= 0.2 THEN 'medium' ELSE 'low' END AS overlap FROM shares"""


@query(_overlap_sql())
def overlap_band(s: Source):
    told = s.documents.select("doc_id", F.col("text").alias("explanation"))
    sources = s.benchmark.select(F.col("text").alias("source"))
    banded = overlap.overlap_band(told, sources, key="doc_id")
    return banded.select("doc_id", F.round("overlap_share", 6).alias("overlap_share"), "overlap")


@query(_overlap_sql("UNION ALL SELECT " + TOKENS.format("text") + " FROM conversations WHERE role = 'assistant'"))
def ai_comment_overlap(s: Source):
    told = s.documents.select("doc_id", F.col("text").alias("explanation"))
    sources = s.benchmark.select(F.col("text").alias("source"))
    comments = s.conversations.filter("role = 'assistant'").select(F.col("text").alias("source"))
    banded = policy.ai_comment_overlap(told, sources, comments, key="doc_id")
    return banded.select("doc_id", F.round("overlap_share", 6).alias("overlap_share"), "overlap")
