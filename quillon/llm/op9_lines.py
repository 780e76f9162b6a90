"""Line dedup by an exact set-similarity join, in DataFrame functions alone.

A line's tokens are its runs of five words (a shorter line: the whole of it). Two lines match if the
Jaccard similarity of their token sets is at least 0.8; a line goes if an earlier one matches it, by
(document id, line number). Lines with the same words are one set, known by two 64-bit hashes.

The join runs in three steps, each exact.

1. Which lines can match at all. Tokens in the order of their hashes; of n tokens a line posts the first
   n - ceil(0.8 n) + SHARED. What a line doesn't post are its last ceil(0.8 n) - SHARED tokens. Two matching
   lines share at least ceil(0.8 N) tokens, N the larger size, and of those only the last ceil(0.8 N) - SHARED
   are not posted by both. So both post at least min(SHARED, ceil(0.8 N)) common tokens, and a line that has fewer
   posted tokens in common with other lines matches none.
2. Of these lines, a token posted by at most RARE is rare. Lines are paired by rare tokens, and the common tokens of
   a pair counted. A line goes by its number; its place, (document id, line number), is looked at as pairs are verified. With p posted tokens of n, tokens that two lines share but don't both post are among the n - p
   last ones of the line whose posted tokens end first. So a matching pair posts at least 4/9 (n + n') -
   max(n - p, n' - p') in common; of those at most the smaller number of common tokens either line posts isn't counted.
   Pairs that reach this are verified on the whole sets.
3. Two matching lines without a rare token in common both post at least min(SHARED, ceil(0.8 N)) common ones. Lines
   with so many have all their tokens counted. Tokens are ordered by that count, the rarest first, then
   by hash. A token of one line alone is rarest of all and matches nothing, so only shared tokens are kept; a
   line with fewer than ceil(0.8 n) of them is done. The others are joined on the tokens of their prefix under
   length and positional filters, and verified on the whole sets. Each line is first held against the earliest line
   of each of its tokens, which settles large groups of near copies in one pass; what is left is a semi join.

No more than RARE lines are paired by one token, and no token's lines are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import free_name, materialise, materialise_alone, table

WORDS = 5
#: Similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Posted tokens that two matching lines have in common at least (all that must match, if those are fewer).
SHARED = 3
#: A posted token of more lines than this is common: its lines aren't paired by it.
RARE = 16
_GAP = r"[\x20\x09\x0B-\x0D]+"
_EDGE = " \t\x0b\x0c\r"
_ODD = " OR ".join(f"contains(text, '{c}')" for c in ("  ", *_EDGE[1:]))
#: Of n tokens, how many a match shares at least, and the length of the prefix.
_MOST = f"cast(({NUMERATOR} * n + {DENOMINATOR - 1}) div {DENOMINATOR} as int)"
_PREFIX = f"(n - {_MOST} + 1)"
#: How many tokens a line posts.
_POSTED = f"least(n, {_PREFIX} + {SHARED - 1})"
#: A line without outer white space; of a text that isn't odd it can only be spaces, whose removal is much cheaper.
_NORM = f"CASE WHEN odd THEN trim(BOTH '{_EDGE}' FROM line) ELSE trim(line) END"


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text): `row` tells texts of one id apart."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("row"), F.col(f"`{text_col}`").alias("text"))


def _words(norm: str = "norm") -> str:
    """A line's words, as SQL; a line has no outer white space. In a text that isn't odd single spaces part them."""
    return f"CASE WHEN odd THEN split({norm}, r'{_GAP}', -1) ELSE split({norm}, ' ', -1) END"


def _tokens() -> str:
    """The line's distinct tokens by hash, as SQL. The line's words are bound to w once; they are never a column,
    which would copy them. What is in the lambda is interpreted, so only the hashing is there."""
    run = ", ".join(f"w[i + {k}]" for k in range(1, WORDS))
    runs = f"transform(slice(w, 1, greatest(size(w) - {WORDS - 1}, 0)), (x, i) -> xxhash64(x, {run}))"
    return f"sort_array(array_distinct(transform(array({_words()}), w -> {runs})[0]))"


def _post(docs: DataFrame) -> DataFrame:
    """(num, id, row, odd, line_no, h1, h2, n, posted) of all lines that hold a word. Lines of fewer than five words have
    n = 0 and post nothing: their one token is no run of any other line."""
    lines = docs.withColumn("odd", F.expr(_ODD)).select("id", "row", "odd", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.select("id", "row", "odd", "line_no", F.expr(_NORM).alias("norm")).filter("norm <> ''")
    same = F.expr(f"CASE WHEN odd THEN array_join({_words()}, ' ') ELSE norm END")
    known = lines.select("id", "row", "line_no", "odd", "norm", F.xxhash64(same).alias("h1"), F.xxhash64(F.lit(1), same).alias("h2"))
    sized = known.select("id", "row", "odd", "line_no", "h1", "h2", F.expr(_tokens()).alias("toks")).withColumn("n", F.size("toks"))
    return sized.select(F.monotonically_increasing_id().alias("num"), "id", "row", "odd", "line_no", "h1", "h2", "n", F.expr(f"slice(toks, 1, {_POSTED})").alias("posted"))


def _held(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the lines, each set's first, that step 1 leaves: (num, at, odd), and their posted tokens that others of them
    post too, with how many do: (tok, num, n, df)."""
    each = posts.select("h1", F.explode("posted").alias("tok"))
    common = materialise(each.groupBy("tok").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a < b").select("tok"), "posted")
    # Tokens travel with a line's number alone.
    held = materialise(posts.select("num", F.explode("posted").alias("tok")).join(common, "tok", "left_semi"), "held")
    lines = posts.filter("n > 0").select("num", "h1", "h2", "n", "odd", F.struct("id", "line_no", "row").alias("at"))
    enough = lines.join(held.groupBy("num").agg(F.count("*").alias("c")), "num").filter(F.expr(f"c >= least({SHARED}, {_MOST})"))
    # Lines of one set post the same, so all of them are here.
    first = materialise(enough.groupBy("h1", "h2").agg(F.min(F.struct("at", "num", "n", "odd")).alias("first")).select("first.*"), "enough")
    rows = materialise(held.join(first.select("num", "n"), "num").select("tok", "num", "n"), "rows")
    counts = rows.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1")
    return first.select("num", "at", "odd"), materialise(rows.join(counts, "tok"), "marked")


def _pairs(marked: DataFrame, hot: DataFrame) -> DataFrame:
    """(lnum, enum) of two lines with a rare posted token in common that step 2 leaves, once each; which is the earlier
    one is seen as they are verified."""
    num, den = NUMERATOR, DENOMINATOR
    rare = marked.filter(f"df <= {RARE}")
    sizes = F.expr(f"e.num < l.num AND {den} * e.n >= {num} * l.n AND {den} * l.n >= {num} * e.n")
    met = rare.alias("l").join(rare.alias("e"), F.col("l.tok") == F.col("e.tok")).filter(sizes)
    met = met.groupBy(*[F.col(f"{x}.{c}").alias(x + c) for x in "le" for c in ("num", "n")]).agg(F.count("*").alias("c"))
    for x in "le":
        met = met.join(hot.select(F.col("num").alias(f"{x}num"), F.col("hot").alias(f"{x}h")), f"{x}num", "left")
    # n - p grows with n.
    shared = f"c + least(coalesce(lh, 0), coalesce(eh, 0)) + greatest({_MOST.replace('* n', '* greatest(ln, en)')} - {SHARED}, 0)"
    return met.filter(f"{num + den} * ({shared}) >= {num} * (ln + en)").select("lnum", "enum")


def _whole(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(num, at, crowd, n, said, toks) of the lines (num, at, odd, crowd): all tokens by hash; said holds the words of a
    line of one token, which has nothing else to be verified by."""
    wanted = wanted.groupBy(F.col("at.id").alias("wid"), F.col("at.row").alias("wrow"), "odd").agg(F.collect_list(F.struct("at.line_no", "num", "crowd")).alias("wanted"))
    texts = docs.join(wanted, docs["id"].eqNullSafe(F.col("wid")) & (docs["row"] == F.col("wrow")))
    texts = texts.select("id", "row", "odd", F.split("text", "\n", -1).alias("ls"), F.explode("wanted").alias("w")).select("id", "row", "odd", "ls", "w.*")
    lines = texts.select("num", F.struct("id", "line_no", "row").alias("at"), "crowd", "odd", F.get("ls", "line_no").alias("line")).withColumn("norm", F.expr(_NORM))
    runs = lines.select("num", "at", "crowd", "odd", "norm", F.expr(_tokens()).alias("toks")).withColumn("n", F.size("toks"))
    said = F.expr(f"CASE WHEN n = 1 THEN array_join(slice({_words()}, 1, {WORDS}), ' ') END").alias("said")
    return materialise(runs.select("num", "at", "crowd", "n", said, "toks"), "tokens")


def _shared_tokens(whole: DataFrame) -> DataFrame:
    """(at, n, said, toks) of the lines with enough shared tokens: toks holds these alone, rarest first."""
    each = whole.select("num", F.explode("toks").alias("tok"))
    counts = each.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1")
    shared = materialise(each.join(counts, "tok"), "shared")
    enough = shared.groupBy("num").agg(F.count("*").alias("c")).join(whole.select("num", "n", "at", "said"), "num").filter(F.expr(f"c >= {_MOST}"))
    enough = materialise(enough.select("num", "n", "at", "said"), "enough")
    ordered = shared.join(enough.select("num"), "num", "left_semi").groupBy("num").agg(F.sort_array(F.collect_set(F.struct("df", "tok"))).alias("shared"))
    return materialise(ordered.join(enough, "num").select("at", "n", "said", F.col("shared.tok").alias("toks")), "ordered")


def _matched(lines: DataFrame) -> DataFrame:
    """(at) of every line that an earlier one matches."""
    num, den = NUMERATOR, DENOMINATOR
    sizes = "e.at < l.at AND {den} * e.n >= {num} * l.n AND {den} * l.n >= {num} * e.n AND {both} * least(l.n - l.pos, e.n - e.pos) >= {num} * (l.n + e.n)"
    whole = "l.said <=> e.said AND {both} * size(array_intersect(l.toks, e.toks)) >= {num} * (l.n + e.n)"
    sizes, whole = (x.format(num=num, den=den, both=num + den) for x in (sizes, whole))
    # Tokens of one line alone, n - size(toks), come before the shared ones in each prefix.
    alone = "(n - size(toks))"
    rows = lines.select("at", "n", F.expr(alone).alias("alone"), F.posexplode(F.expr(f"slice(toks, 1, {_PREFIX} - {alone})")).alias("k", "tok"))
    rows = materialise(rows.select("at", "n", (F.col("alone") + F.col("k")).alias("pos"), "tok"), "prefixes")
    # First against the earliest line of each token.
    tops = materialise(rows.groupBy("tok").agg(F.min(F.struct("at", "n", "pos")).alias("e"), F.count("*").alias("c")).filter("c > 1"), "tops")
    pairs = rows.alias("l").join(tops.alias("t"), "tok").filter(F.expr(sizes.replace("e.", "t.e."))).select(F.col("l.at").alias("la"), F.col("t.e.at").alias("ea")).distinct()
    found = pairs.join(lines.alias("e"), F.expr("ea = e.at")).join(lines.alias("l"), F.expr("la = l.at")).filter(F.expr(whole))
    settled = materialise(found.select("l.at").distinct(), "settled")
    # Then, where a token has more lines, the lines that are left against all.
    many = rows.join(tops.filter("c > 2").select("tok"), "tok", "left_semi")
    right = many.join(lines.select("at", "toks", "said"), "at")
    left = right.join(settled, "at", "left_anti")
    more = left.alias("l").join(right.alias("e"), F.expr(f"l.tok = e.tok AND {sizes} AND {whole}"), "left_semi").select("at").distinct()
    return settled.unionByName(more)


def _late(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """(at) of every set's first place that an earlier line matches."""
    first, marked = _held(posts)
    hot = materialise(marked.filter(f"df > {RARE}").groupBy("num", "n").agg(F.count("*").alias("hot")), "hot")
    pairs = materialise(_pairs(marked, hot), "pairs")
    # All lines that are cut again: those of pairs, and those that step 3 is about.
    crowd = hot.filter(F.expr(f"hot >= least({SHARED}, {_MOST})")).select("num", F.lit(1).alias("crowd"))
    met = [pairs.select(F.col(c).alias("num"), F.lit(0).alias("crowd")) for c in ("lnum", "enum")]
    met = met[0].unionByName(met[1]).unionByName(crowd).groupBy("num").agg(F.max("crowd").alias("crowd"))
    whole = _whole(docs, first.join(met, "num"))
    both = pairs.join(whole.alias("l"), F.expr("lnum = l.num")).join(whole.alias("e"), F.expr("enum = e.num"))
    same = f"l.said <=> e.said AND {NUMERATOR + DENOMINATOR} * size(array_intersect(l.toks, e.toks)) >= {NUMERATOR} * (l.n + e.n)"
    later = F.expr("CASE WHEN e.at < l.at THEN l.at ELSE e.at END").alias("at")
    found = materialise(both.filter(F.expr(same)).select(later).distinct(), "found")
    if crowd.isEmpty():
        return found
    return found.unionByName(_matched(_shared_tokens(whole.filter("crowd = 1")))).distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, line_no) of every line with words that has an earlier match; row: xxhash64 of the text.
    A place that rows repeated whole share may be given more than once."""
    texts = _documents(docs, id_col, text_col)
    posts = materialise(_post(texts), "posts")
    # Sets of one line alone are told by numbers; only the lines of the others have their places compared. Sums are written
    # before they are joined: then a very common line's rows can be dealt to several tasks.
    copied = materialise(posts.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").select("h1", "h2"), "copied")
    copies = materialise(posts.select("h1", "h2", F.struct("id", "line_no", "row").alias("at")).join(copied, ["h1", "h2"], "left_semi"), "copies")
    # Lines of a set that has no earlier match stay at the set's first place alone.
    gone = materialise_alone(lambda: _late(texts, posts), docs.sparkSession, "matched")
    firsts = materialise(copies.groupBy("h1", "h2").agg(F.min("at").alias("first")), "firsts")
    again = copies.join(firsts, ["h1", "h2"]).filter("at <> first").select("at")
    return again.unionByName(gone).select("at.id", "at.row", "at.line_no")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all columns, matched lines taken out of their texts, and n_lines, n_removed (lines with
    words; if the table has such a column, with "_" added to the name). Lines without a word stay, as do all other
    bytes. Null text: stays null, no lines. Null ids come first in the order and are one place. Rows that repeat
    an id are judged by their own texts; rows repeated whole are one place and share what goes. A text of any length
    is one array of lines. Empty table: empty."""
    used = [c.lower() for c in docs.columns]
    gone_id, gone_row, gone, lines, flags = (free_name(used, c) for c in ("gone_id", "gone_row", "gone", "lines", "flags"))

    def find() -> DataFrame:
        found = removed_lines(docs, id_col, text_col).groupBy("id", "row").agg(F.sort_array(F.collect_set("line_no")).alias(gone))
        return found.select(F.col("id").alias(gone_id), F.col("row").alias(gone_row), gone)

    found = materialise_alone(find, docs.sparkSession, "removed")
    text = F.col(f"`{text_col}`")
    both = docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)) & (F.xxhash64(text) == F.col(gone_row)), "left")
    # One character for each line up to the last that goes.
    marks = F.expr(f"split(concat_ws('', transform({gone}, (k, i) -> concat(repeat('0', k - if(i = 0, 0, {gone}[i - 1] + 1)), '1'))), '')")
    out = both.withColumn(flags, marks).withColumn(lines, F.split(text, "\n", -1))
    left = F.expr(f"array_join(filter({lines}, (x, i) -> coalesce(get({flags}, i), '0') = '0'), '\n')")
    n_lines = F.expr(f"cast(CASE WHEN {lines} IS NULL THEN 0 ELSE size(filter({lines}, x -> ascii(x) > 32 OR trim(BOTH '{_EDGE}' FROM x) <> '')) END as bigint)")
    n_removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    return out.select(
        *[F.when(F.col(gone).isNull(), text).otherwise(left).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        n_lines.alias(free_name(used, "n_lines")),
        n_removed.alias(free_name(used, "n_removed")),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


#: The same by counting shared tokens of all pairs of distinct lines that share one.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i AS line_no, trim(str[i], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS norm
  FROM (SELECT doc_id, string_split(text, chr(10)) AS str, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
),
sets AS (SELECT norm, min({'d': doc_id, 'l': line_no}) AS pos FROM lines WHERE norm <> '' GROUP BY norm),
words AS (SELECT norm, pos, string_split_regex(norm, '[\x20\x09\x0B-\x0D]+') AS w FROM sets),
tokens AS (
  SELECT DISTINCT norm, pos, unnest(CASE WHEN len(w) <= 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS tok FROM words
),
sizes AS (SELECT norm, count(*) AS n FROM tokens GROUP BY norm),
pairs AS (SELECT a.norm AS late, b.norm AS early, count(*) AS shared FROM tokens a JOIN tokens b ON a.tok = b.tok AND b.pos < a.pos GROUP BY 1, 2),
gone AS (SELECT DISTINCT late FROM pairs JOIN sizes x ON x.norm = late JOIN sizes y ON y.norm = early WHERE 9 * shared >= 4 * (x.n + y.n)),
flagged AS (
  SELECT d.doc_id, d.line_no, d.norm <> '' AS counted,
    d.norm = '' OR (s.pos.d = d.doc_id AND s.pos.l = d.line_no AND g.late IS NULL) AS keep
  FROM lines d LEFT JOIN sets s ON s.norm = d.norm LEFT JOIN gone g ON g.late = d.norm
),
raw AS (SELECT doc_id, string_split(text, chr(10)) AS str FROM documents)
SELECT f.doc_id, count(*) FILTER (WHERE counted) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_removed,
  sha256(coalesce(string_agg(str[line_no], chr(10) ORDER BY line_no) FILTER (WHERE keep), '')) AS text_sha256
FROM flagged f JOIN raw USING (doc_id) GROUP BY f.doc_id
"""
