"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Each kind's pattern gives spans in every whole text; offsets come from the lengths of the matches and of
the text between them. The value in each span is hashed, and for every hash the distinct owners and
repositories that hold it are counted over the whole corpus: values of several owners or of many repositories
are copied examples, values of few repositories of one or two owners look live. A repository is a text of an owner, so
copies of one document count once. Base spans always stay; opaque strings are added only if they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import free_name, materialise, table

#: Kinds in order: name, pattern, group that holds the value, least length of that group, pattern that a
#: text must hold for the kind to be looked for (fixed values).
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i)(?:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]"""),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, r"AKIA"),
    # A maximal run that is long enough: leftmost greedy matching takes whole runs, so shorter ones never overlap it.
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
    ("opaque", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}", 0, 24, r"[A-Za-z0-9+/_-]{24}"),
]
BASE = 3
#: Owners from which on a value counts as a copied example.
EXAMPLE_OWNERS = 3
#: Repositories from which on it does, whoever owns them: an example spread through one owner's texts.
EXAMPLE_REPOS = 25
MASK = "[SECRET]"
#: Matches whose places are summed up together.
_PART = 256
_SPAN = "array<struct<start:int,kind:int,stop:int,value:bigint>>"


def _spans(text: Column, number: int) -> Column:
    _, pattern, group, least, hint = KINDS[number]
    held = text.rlike(hint)
    none = F.array().cast("array<string>")
    match = F.when(held, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    gaps = F.when(held, F.split(text, pattern, -1)).otherwise(none)
    values = F.when(held, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none) if group else match
    rows = F.arrays_zip(match.alias("m"), F.slice(gaps, 1, F.size(match)).alias("g"), values.alias("v"))

    def add(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["g"])
        stop = start + F.length(row["m"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), stop.alias("stop"), F.xxhash64(row["v"]).alias("value"))
        return F.struct(stop.alias("at"), F.when(F.length(row["v"]) >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def join(state: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), s["kind"].alias("kind"), (s["stop"] + state["at"]).alias("stop"), s["value"].alias("value")))
        return F.struct((state["at"] + part["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    # Adding to an array copies it, so places are summed up part by part: a text of very many matches costs little more for each.
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(rows) / _PART).cast("int")), lambda c: F.aggregate(F.slice(rows, c * _PART + 1, F.lit(_PART)), start, add))
    whole = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), join, lambda state: F.flatten(state["out"]))
    return F.when(held, whole).otherwise(F.array().cast(_SPAN))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """(id, owner, repo, spans, sorted by start and kind). Null text: as empty. A null owner is one owner of its own.
    A text of any length is searched whole. Repeated rows: one each."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("\0")).alias("owner"), text.alias("text"))
    found = rows.select("id", "owner", F.xxhash64("text").alias("repo"), *[_spans(F.col("text"), k).alias(f"k{k}") for k in range(len(KINDS))])
    return found.select("id", "owner", "repo", F.array_sort(F.concat(*[F.col(f"k{k}") for k in range(len(KINDS))])).alias("spans"))


def ownership(spans: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners) over all rows. Counts are added up step by step (value, owner, repository;
    value, owner; value), so a value that a third of all documents hold shrinks on the map side before it meets."""
    one = spans.select("repo", "owner", F.explode("spans").alias("s")).select(F.col("s.value").alias("value"), "owner", "repo").groupBy("value", "owner", "repo").agg(F.lit(1).alias("x"))
    owners = one.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def flag_spans(spans: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """(live_id, live_repo, spans, most_owners, most_repos) of documents with spans, each span with `live`: whether
    its value looks live; and how widely the document's most copied value is held."""
    each = spans.select("id", "repo", F.explode("spans").alias("s")).select("id", "repo", "s", F.col("s.value").alias("value"))
    known = ownership(spans).withColumn("live", (F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos))
    told = each.join(known, "value").groupBy(F.col("id").alias("live_id"), F.col("repo").alias("live_repo"))
    flagged = F.struct("s.start", "s.kind", "s.stop", "live").alias("s")
    return told.agg(F.array_sort(F.collect_set(flagged)).alias("spans"), F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"))


def _with_live(found: DataFrame) -> DataFrame:
    """(id, repo, spans with live, most_owners, most_repos) of every row; no spans: null."""
    told = flag_spans(found.filter(F.size("spans") > 0))
    return found.select("id", "repo").join(told, F.col("id").eqNullSafe(F.col("live_id")) & (F.col("repo") == F.col("live_repo")), "left")


def _names(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row for each document: counts of base spans, digest of them, all spans, how many look live, and the
    owners and repositories of its most widely held value. Null text: as empty. Repeated rows: one result each. An
    empty table gives no rows. Only the three columns named are read."""
    found = materialise(find_spans(docs, id_col, text_col, owner_col), "spans")
    both = _with_live(found).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,stop:int,live:boolean>>")))
    kept = F.filter("spans", lambda s: (s["kind"] < BASE) | s["live"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return both.select(
        F.col("id").alias(id_col),
        *[count(k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        F.sha2(_names(F.filter("spans", lambda s: s["kind"] < BASE)), 256).alias("base_sha256"),
        _names(kept).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.coalesce("most_owners", F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce("most_repos", F.lit(0)).cast("long").alias("most_repos"),
    )


def mask_live(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mask: str = MASK) -> DataFrame:
    """The documents with all columns; in text, every span whose value looks live is replaced by `mask`
    (overlapping spans by one). Copied examples stay. A null text stays null. Rows that repeat an id are masked
    by their own texts. Other columns may have any names."""
    used = [c.lower() for c in docs.columns]
    hit_id, hit_repo, hits = (free_name(used, c) for c in ("hit_id", "hit_repo", "hits"))
    found = materialise(find_spans(docs, id_col, text_col, owner_col), "spans").filter(F.size("spans") > 0)
    live = flag_spans(found).select(F.col("live_id").alias(hit_id), F.col("live_repo").alias(hit_repo), F.filter("spans", lambda s: s["live"]).alias(hits))
    hit = live.filter(F.size(hits) > 0)
    text = F.col(f"`{text_col}`")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(hit_id)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(hit_repo))
    both = docs.join(hit, same, "left")

    def cut(state: Column, s: Column) -> Column:
        before = text.substr(state["at"] + 1, s["start"] - state["at"])
        fresh = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(state["out"], before, F.lit(mask))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(hits, start, cut, lambda state: F.concat(state["out"], text.substr(state["at"] + 1, F.length(text))))
    return both.select(*[F.when(F.col(hits).isNull(), text).otherwise(masked).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_FOUND = """SELECT doc_id, source, text, {number} AS kind, '{name}' AS name, {least} AS least, regexp_extract_all(text, '{pattern}', 0) AS ms,
  regexp_extract_all(text, '{pattern}', {group}) AS vs, string_split_regex(text, '{pattern}') AS gs FROM texts"""
#: DuckDB's patterns have no look-around: hex runs are whole anyway, opaque ones are told by what they hold.
_PLAIN = {"hex": r"[0-9a-f]{24,}", "opaque": r"[A-Za-z0-9+/_-]{24,}"}
#: The same in DuckDB.
ORACLE = (
    "WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents), found AS (\n"
    + "\nUNION ALL\n".join(_FOUND.format(number=k, name=name, least=least, group=group, pattern=_PLAIN.get(name, pattern).replace("'", "''")) for k, (name, pattern, group, least, _) in enumerate(KINDS))
    + """),
each AS (
  SELECT doc_id, source, text, kind, name, ms[i] AS m, vs[i] AS v, least,
    coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found)
),
spans AS (
  SELECT doc_id, source, text, kind, name, v, CAST(start AS BIGINT) AS start, CAST(start + length(m) AS BIGINT) AS stop FROM each
  WHERE length(v) >= least AND (kind < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')))
),
owners AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS n, count(DISTINCT {'o': coalesce(source, chr(1)), 't': text}) AS r FROM spans GROUP BY v),
told AS (SELECT s.*, o.n AS n_owners, o.r AS n_repos, o.n < """
    + str(EXAMPLE_OWNERS)
    + " AND o.r < "
    + str(EXAMPLE_REPOS)
    + """ AS live, s.name || ':' || s.start || ':' || s.stop AS said FROM spans s JOIN owners o ON o.v = s.v),
sums AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(said, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(said, ',' ORDER BY start, kind) FILTER (WHERE kind < 3 OR live) AS spans,
    count(*) FILTER (WHERE live) AS n_live, max(n_owners) AS most_owners, max(n_repos) AS most_repos FROM told GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM texts t LEFT JOIN sums ON sums.doc_id = t.doc_id
"""
)
