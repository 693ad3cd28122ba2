"""Secret scans through a trigram inverted index (DataFrame functions only).

From each rule's regular expression a Boolean query over trigrams is derived
when the job is planned: an OR of ANDs of lower-case trigrams that every match
must hold. One pass over the texts writes which of the queries' trigrams each
text has. Their postings (trigram, text) are joined with the queries and
intersected: a text is a candidate of a rule if it has all trigrams of one of
the rule's alternatives. Rules without mandatory trigrams scan every text in
that first pass. Candidates are verified with the full expression; all others
are never touched again: texts are found by a key filter where they lie, and
only candidates are shuffled.

Spans of a kind are the expression's leftmost non-overlapping matches whose
relevant part is long enough; a match that is too short is dropped and its
characters are used up.

Defined cases: a null text is an empty one without spans; rows of equal text
get the same spans, and copies are verified once; null and repeated ids give one row each; an empty
table gives an empty result; other columns are ignored. Two texts are taken as
equal when their 128-bit hashes are.
"""

from __future__ import annotations

import re
from itertools import product
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


class Rule(NamedTuple):
    """``pattern`` is plain enough to mean the same in Java, Python and RE2; ``group`` is what must have ``least`` characters.

    ``probe`` is found in every text with a match that is long enough (empty: the pattern is).
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    probe: str = ""


BASE = ("assign", "access", "hex")
RULES = [
    # Fixed by the contract.
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
    # Added: keys, tokens and key blocks with a form of their own.
    Rule("access_temporary", r"\b(?:ASIA|AROA|AIDA|ANPA)[A-Z0-9]{16}\b"),
    Rule("age_key", r"AGE-SECRET-KEY-1[0-9A-Z]{58}"),
    Rule("atlassian", r"\bATATT3[A-Za-z0-9_=-]{180,}"),
    Rule("authorization", r"(?i)authorization:\x20*(?:basic|bearer|token)\x20+[A-Za-z0-9+/_.=~-]{16,}"),
    Rule("azure_storage", r"(?i)AccountKey=[A-Za-z0-9+/]{86}=="),
    Rule("bot_chat", r"\b[0-9]{8,10}:AA[A-Za-z0-9_-]{33}\b"),
    Rule("cloud_oauth", r"\bya29\.[A-Za-z0-9_-]{20,}"),
    Rule("connection", r"(?i)\b(?:postgres|postgresql|mysql|mongodb|mongodb\+srv|redis|rediss|amqp|amqps|ftp|https?)://[^\x00-\x20:/@\"'<>]+:[^\x00-\x20/@\"'<>]+@[A-Za-z0-9.-]+"),
    Rule("database_cloud", r"\bdapi[0-9a-f]{32}\b"),
    Rule("docker", r"\bdckr_pat_[A-Za-z0-9_-]{27}"),
    Rule("doppler", r"\bdp\.pt\.[A-Za-z0-9]{43}"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    Rule("github_fine", r"\bgithub_pat_[A-Za-z0-9_]{82}\b"),
    Rule("gitlab", r"\bgl(?:pat|dt|rt|ptt|cbt|oas)-[A-Za-z0-9_-]{20,}"),
    Rule("google_api", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("grafana", r"\bglsa_[A-Za-z0-9]{32}_[0-9a-f]{8}\b"),
    Rule("hook_chat", r"https://hooks\.slack\.com/(?:services|workflows)/[A-Za-z0-9+/]{20,}"),
    Rule("hook_discord", r"https://(?:discord|discordapp)\.com/api/webhooks/[0-9]{17,20}/[A-Za-z0-9_-]{60,}"),
    Rule("json_web_token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("linear", r"\blin_api_[A-Za-z0-9]{40}\b"),
    Rule("mail_grid", r"\bSG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("mail_gun", r"\bkey-[0-9a-f]{32}\b"),
    Rule("mail_list", r"\b[0-9a-f]{32}-us[0-9]{1,2}\b"),
    Rule("notebook", r"\bhf_[A-Za-z0-9]{34,}\b"),
    Rule("npm", r"\bnpm_[A-Za-z0-9]{36}\b"),
    Rule("payment", r"\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    Rule("payment_square", r"\bsq0(?:atp|csp)-[A-Za-z0-9_-]{22,43}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----"),
    Rule("pulumi", r"\bpul-[0-9a-f]{40}\b"),
    Rule("pypi", r"\bpypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}"),
    Rule("rubygems", r"\brubygems_[0-9a-f]{48}\b"),
    Rule("shopify", r"\bshp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}\b"),
    Rule("slack", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("telephony", r"\b(?:SK|AC)[0-9a-f]{32}\b"),
    Rule("vault", r"\bhv[sbr]\.[A-Za-z0-9_-]{24,}"),
    Rule("vpn_private", r"(?i)PrivateKey\x20*=\x20*[A-Za-z0-9+/]{43}="),
]

# ---- trigram queries -------------------------------------------------------------

MAX_STRINGS = 64      # alternatives of a literal stretch that are followed one by one
MAX_CLASS = 8         # characters of a class that are followed one by one


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def _strings(node) -> list[str] | None:
    """All lower-case strings of a piece of an expression, if they are few."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return [chr(arg).lower()] if arg < 128 else None
    if name == "AT":
        return [""]
    if name == "IN":
        chars = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                chars.add(x)
            elif str(kind) == "RANGE" and x[1] - x[0] < MAX_CLASS:
                chars.update(range(x[0], x[1] + 1))
            else:
                return None
        return sorted({chr(c).lower() for c in chars}) if len(chars) <= MAX_CLASS and max(chars) < 128 else None
    if name == "SUBPATTERN":
        return _sequence_strings(arg[-1])
    if name == "BRANCH":
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else sorted({s for p in parts for s in p})
    if name == "MAX_REPEAT":
        low, high, inner = arg
        base = _sequence_strings(inner)
        if base is None or not isinstance(high, int) or high > 4:
            return None
        out = {"".join(x) for n in range(low, int(high) + 1) for x in product(base, repeat=n)} if len(base) ** int(high) <= MAX_STRINGS else None
        return None if out is None else sorted(out)
    return None


def _sequence_strings(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = [a + b for a in out for b in more]
    return out


Query = list[frozenset[str]]  # alternatives, all trigrams of one of which are mandatory; [frozenset()]: nothing is


def _least(alternatives: set[frozenset[str]]) -> Query:
    """Without alternatives that ask for more than another one."""
    kept = [a for a in alternatives if not any(b < a for b in alternatives)]
    return sorted(kept, key=lambda a: (len(a), sorted(a)))


def _both(a: Query, b: Query) -> Query:
    out = _least({x | y for x in a for y in b})
    return out if len(out) <= MAX_STRINGS else min(a, b, key=len)


def _sequence_query(nodes) -> Query:
    """Query of a sequence: of each longest stretch of literal pieces, and of what lies between."""
    out: Query = [frozenset()]
    run = [""]
    for node in [*nodes, None]:
        more = None if node is None else _strings(node)
        if more is not None and len(run) * len(more) <= MAX_STRINGS:
            run = [a + b for a in run for b in more]
            continue
        out = _both(out, _least({trigrams(s) for s in run}))
        run = [""] if more is None else more
        if node is None or more is not None:
            continue
        op, arg = node
        if str(op) == "SUBPATTERN":
            out = _both(out, _sequence_query(arg[-1]))
        elif str(op) == "BRANCH":
            out = _both(out, _least({a for x in arg[1] for a in _sequence_query(x)}))
        elif str(op) == "MAX_REPEAT" and arg[0] > 0:
            out = _both(out, _sequence_query(arg[2]))
    return out


def trigram_query(pattern: str) -> Query:
    """Trigrams of the lower-cased text that every match needs: an OR of ANDs."""
    from re import _parser as parser  # the expression as Python's own compiler reads it

    return _sequence_query(parser.parse(pattern))


# ---- the job -----------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def index(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str) -> DataFrame:
    """Per document: its id and content key, the queries' trigrams its text has, and the kinds that scan every text and may match."""
    queries = {r: trigram_query(r.pattern) for r in rules}
    wanted = sorted({t for q in queries.values() if frozenset() not in q for a in q for t in a})
    scanning = [r for r in rules if frozenset() in queries[r]]
    held = ", ".join(f"IF(contains(lowered, {_quoted(t)}), {_quoted(t)}, NULL)" for t in wanted)
    kinds = ", ".join(f"IF(rlike(text, {_quoted(r.probe or r.pattern)}), {_quoted(r.kind)}, NULL)" for r in scanning)
    text = common.text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.lower(text).alias("lowered"), *common.content_key(text))
    none = "cast(array() AS array<string>)"
    return rows.select(
        "doc_id", "key_a", "key_b",
        F.expr(f"array_compact(array({held}))" if held else none).alias("trigrams"),
        F.expr(f"array_compact(array({kinds}))" if kinds else none).alias("kinds"),
    )


def candidates(indexed: DataFrame, rules: list[Rule]) -> DataFrame:
    """key_a, key_b and the kinds to verify, by intersecting postings."""
    spark = indexed.sparkSession
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    entries = [
        (t, kind, number, len(a)) for kind, q in queries.items() if frozenset() not in q for number, a in enumerate(q) for t in a
    ]
    asked = spark.createDataFrame(entries, "trigram string, kind string, alternative int, need int")
    keys = ["key_a", "key_b"]
    postings = indexed.select(*keys, F.explode("trigrams").alias("trigram"))
    # The queries are a few hundred rows, whatever the data.
    met = (
        postings.join(F.broadcast(asked), "trigram")
        .groupBy(*keys, "kind", "alternative", "need").agg(F.count_distinct("trigram").alias("have")).where("have = need")
        .select(*keys, "kind")
    )
    scanned = indexed.select(*keys, F.explode("kinds").alias("kind"))
    return met.unionByName(scanned).groupBy(*keys).agg(F.collect_set("kind").alias("kinds"))


def verified(docs: DataFrame, found: DataFrame, rules: list[Rule], text_col: str) -> DataFrame:
    """Spans (key_a, key_b, kind, first, last exclusive) of the candidates."""
    keys = ["key_a", "key_b"]
    text = common.text_of(text_col)
    rows = common.may_hold(docs.select(text.alias("text"), *common.content_key(text)), found, "key_a").where("may_hold")
    once = rows.groupBy(*keys).agg(F.first("text").alias("text"))
    table = ", ".join(
        f"named_struct('kind', {_quoted(r.kind)}, 'pattern', {_quoted(r.pattern)}, 'part', {r.group}, 'least', {r.least})" for r in rules
    )
    each = once.join(found, keys).select(
        *keys, "text", F.explode(F.expr(f"filter(array({table}), r -> array_contains(kinds, r.kind))")).alias("r")
    ).select(*keys, "text", "r.*")
    matches = each.select(
        *keys, "kind", "pattern", "part", "least", F.expr("regexp_extract_all(text, pattern, 0)").alias("hits"),
        F.expr("split(text, pattern, -1)").alias("gaps"),
    )
    # Gaps and hits alternate; places are running sums over them.
    pieces = matches.select(
        *keys, "kind", "pattern", "part", "least", F.posexplode(F.expr("zip_with(slice(gaps, 1, size(hits)), hits, (g, h) -> struct(length(g) AS gap, h AS hit))")).alias("n", "p")
    ).select(*keys, "kind", "pattern", "part", "least", "n", "p.gap", "p.hit")
    end = F.expr("sum(gap + length(hit)) OVER (PARTITION BY key_a, key_b, kind ORDER BY n ROWS UNBOUNDED PRECEDING)")
    long_enough = F.expr("length(IF(part = 0, hit, regexp_extract(hit, pattern, part))) >= least")
    return pieces.withColumn("last", end).where(long_enough).select(
        *keys, "kind", (F.col("last") - F.length("hit")).cast("long").alias("first"), F.col("last").cast("long").alias("last")
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """doc_id and spans (kind, first, last exclusive; code points; by start, then in the rules' order) of every document."""
    rules = RULES if rules is None else rules
    indexed = common.materialise(index(docs, rules, id_col, text_col), "secret-index")
    found = common.materialise(candidates(indexed, rules), "secret-candidates")
    order = "element_at(map(" + ", ".join(f"{_quoted(r.kind)}, {n}" for n, r in enumerate(rules)) + "), kind)"
    spans = common.materialise(
        verified(docs, found, rules, text_col).withColumn("rank", F.expr(order))
        .groupBy("key_a", "key_b").agg(F.array_sort(F.collect_list(F.struct("first", "rank", "last", "kind"))).alias("spans")),
        "secret-spans",
    )
    out = common.attach(indexed.select("doc_id", "key_a", "key_b"), spans, ["key_a", "key_b"])
    return out.select("doc_id", F.expr("transform(coalesce(spans, array()), s -> struct(s.kind AS kind, s.first AS first, s.last AS last))").alias("spans"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = find_secrets(common.read_table(spark, sf_dir, "documents"))
    shown = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.first, s.last)), ',')"
    base = "filter(spans, s -> s.kind IN ('" + "', '".join(BASE) + "'))"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(shown.format(base)), 256).alias("base_sha256"),
        F.expr(shown.format("spans")).alias("spans"),
    )


def _oracle() -> str:
    """DuckDB SQL: every rule scans every text."""

    def lit(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    found = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS rank, {lit(r.kind)} AS kind, unnest(list_zip(string_split_regex(t, {lit(r.pattern)})[1:len(m)], m, range(len(m)))) AS p, "
        f"{r.group} AS part, {r.least} AS least, {lit(r.pattern)} AS pattern FROM (SELECT doc_id, t, regexp_extract_all(t, {lit(r.pattern)}) AS m FROM d)"
        for n, r in enumerate(RULES)
    )
    part = " ".join(f"WHEN rank = {n} THEN regexp_extract(p[2], {lit(r.pattern)}, {r.group})" for n, r in enumerate(RULES) if r.group)
    base = ", ".join(lit(k) for k in BASE)
    shown = "coalesce(string_agg(kind || ':' || (upto - length(p[2]))::VARCHAR || ':' || upto::VARCHAR, ',' ORDER BY upto - length(p[2]), rank){0}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
s AS (SELECT doc_id, rank, kind, p, least, CASE {part} ELSE p[2] END AS part,
             (sum(length(p[1]) + length(p[2])) OVER (PARTITION BY doc_id, kind ORDER BY p[3]))::BIGINT AS upto FROM f),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = {lit(k)}) AS n_{k}" for k in BASE)},
             {shown.format(f" FILTER (WHERE kind IN ({base}))")} AS base, {shown.format("")} AS spans
      FROM s WHERE length(part) >= least GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


OP12_SQL = _oracle()
