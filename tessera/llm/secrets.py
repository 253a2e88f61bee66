"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Kinds (fixed patterns, scanned leftmost and without overlap, each kind by itself):

* ``assign``: a keyword (password, passwd, secret, token, api_key, apikey; letters in either
  case), ``:`` or ``=`` and a value of 12 characters or more;
* ``access``: ``AKIA`` with capitals and digits, 18 characters or more;
* ``hex``: 16 lower-case hexadecimal digits or more.

The candidate is the value (``assign``) or the whole match. Candidates are hashed (SHA-256; the
text itself leaves the scan only as hashes and lengths) and aggregated over the corpus by distinct
repositories and owners. A candidate that ``EXAMPLE_OWNERS`` owners or more share is a widely
copied *example*; one that a single owner has and that looks random is *live*; any other is
*unclear*.

Places come from the lengths of the matches and of what lies between them, summed by a window over
the matches of one document and kind. Counts by (hash, repository, owner) come before counts by
hash, so that a hash that a third of all rows hold shrinks to a row for each owner map-side; the
join back splits at a hot hash.

Defined results: a null text is empty; empty texts have no spans and the hash of the empty string;
a null repository or owner is the one with the empty name; repeated rows are reported each; a null id
is carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Fixed patterns. The two with a minimal length match the same spans as without it, since what
#: they scan is a maximal run; the values of ``assign`` are measured after the match.
KINDS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
ASSIGN_LENGTH = 12
EXAMPLE_OWNERS = 3
#: A value looks random with a letter, a digit and so many distinct characters.
RANDOM_CHARACTERS = 8


def _looks_random(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= RANDOM_CHARACTERS)


def _found(kind: str, order: int) -> Column:
    """The kind's matches as structs of what a span needs, in order; failing matches too, since they take place."""
    value, whole, gap = F.col(f"{kind}_value"), F.col(f"{kind}_whole"), F.col(f"{kind}_gap")
    rows = F.arrays_zip(F.slice(gap, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    return F.transform(
        rows,
        lambda x, i: F.struct(
            F.lit(order).alias("kind"),
            i.alias("at"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["whole"]).alias("size"),
            (F.length(x["value"]) >= (ASSIGN_LENGTH if kind == "assign" else 0)).alias("holds"),
            F.sha2(x["value"], 256).alias("hash"),
            _looks_random(x["value"]).alias("random"),
        ),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """(row, id, repository, owner, found) of every document; found lists the matches of all kinds."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(repository.cast("string") if repository is not None else F.lit(None).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(owner.cast("string") if owner is not None else F.lit(None).cast("string"), F.lit("")).alias("owner"),
    )
    for kind, pattern in KINDS.items():
        rows = rows.withColumn(f"{kind}_whole", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    for kind, pattern in KINDS.items():
        some = F.size(f"{kind}_whole") > 0
        rows = rows.withColumn(f"{kind}_gap", F.when(some, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>")))
        value = F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(2))) if kind == "assign" else F.col(f"{kind}_whole")
        rows = rows.withColumn(f"{kind}_value", F.coalesce(value, F.array().cast("array<string>")))
    found = F.concat(*(_found(kind, k) for k, kind in enumerate(KINDS)))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "repository", "owner", found.alias("found"))


def spans(scanned: DataFrame) -> DataFrame:
    """(row, repository, owner, kind, start, end, hash, random) of every secret; places in code points, end exclusive."""
    each = scanned.where(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("m")).select("row", "repository", "owner", "m.*")
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    return placed.where("holds").select("row", "repository", "owner", "kind", "start", "end", "hash", "random")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of every candidate: how many distinct ones have it, over the corpus."""
    by_both = found.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    own = by_both.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("owners"))
    repositories = by_both.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("repositories"))
    return own.join(repositories, "hash")


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Every row's counts, spans and verdicts.

    (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, verdicts); verdicts
    are ``verdict:owners:repositories`` in the order of the spans.
    """
    scanned = checkpoint(scan(docs, id_col, text_col, repository, owner))
    found = spans(scanned)
    verdict = F.when(F.col("owners") >= example_owners, "example").when((F.col("owners") == 1) & F.col("random"), "live").otherwise("unclear")
    judged = found.join(ownership(found), "hash").withColumn("verdict", verdict)
    lists = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "verdict", "owners", "repositories"))).alias("all"))
    text = lambda part: F.array_join(F.transform(F.coalesce("all", F.array().cast(lists.schema["all"].dataType)), part), ",")
    number = lambda name, value: F.size(F.filter(F.coalesce("all", F.array().cast(lists.schema["all"].dataType)), lambda x: x[name] == value)).cast("bigint")
    out = scanned.select("row", "id").join(lists, "row", "left")
    out = out.withColumn("spans", text(lambda x: F.concat_ws(":", _name(x["kind"]), x["start"], x["end"])))
    return out.select(
        F.col("id").alias("doc_id"),
        *(number("kind", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2("spans", 256).alias("base_sha256"),
        "spans",
        number("verdict", "live").alias("n_live"),
        number("verdict", "example").alias("n_example"),
        text(lambda x: F.concat_ws(":", x["verdict"], x["owners"], x["repositories"])).alias("verdicts"),
    )


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_QUOTE = """["'']?"""
_SQL_PATTERNS = {
    "assign": "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + f"){_QUOTE} *[:=] *{_QUOTE}([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}
_SQL_LEAST = {"assign": ASSIGN_LENGTH, "access": 18, "hex": 16}


def oracle(repository: str, owner: str) -> str:
    """DuckDB SQL of ``report`` over the view documents."""
    kinds = " UNION ALL ".join(
        f"""SELECT doc_id, repo, own, {k} AS kind, '{kind}' AS name, unnest(range(len(w))) + 1 AS i, w, g, v FROM
        (SELECT doc_id, repo, own, regexp_extract_all(t, '{p}', 0) AS w, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', {2 if kind == "assign" else 0}) AS v FROM d)"""
        for k, (kind, p) in enumerate(_SQL_PATTERNS.items())
    )
    least = " ".join(f"WHEN {k} THEN {_SQL_LEAST[kind]}" for k, kind in enumerate(KINDS))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce({repository}, '') AS repo, coalesce({owner}, '') AS own FROM documents),
    m AS ({kinds}),
    s AS (SELECT doc_id, repo, own, kind, name, v[i] AS value, length(w[i]) AS size,
        list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS start
        FROM m WHERE length(v[i]) >= CASE kind {least} END),
    h AS (SELECT value, count(DISTINCT own) AS owners, count(DISTINCT repo) AS repos FROM s GROUP BY value),
    j AS (SELECT s.*, owners, repos, CASE WHEN owners >= {EXAMPLE_OWNERS} THEN 'example'
        WHEN owners = 1 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= {RANDOM_CHARACTERS} THEN 'live'
        ELSE 'unclear' END AS verdict FROM s JOIN h USING (value)),
    a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, kind) AS spans,
        count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example,
        string_agg(verdict || ':' || owners || ':' || repos, ',' ORDER BY start, kind) AS verdicts FROM j GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
    coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(verdicts, '') AS verdicts
    FROM documents LEFT JOIN a USING (doc_id)"""
