"""Exact Jaccard self-join on word shingles, and the groups of documents that its links connect.

Adaptive multi-match prefixes. All shingles have one total order: shingles that many documents hold come last, by count,
all others first, by hash. Two sets of which one has n shingles can only reach the threshold if, for every l, their first
n - ceil(0.75 n) + l shingles share l of them. Each document picks its own l: a longer prefix has more
candidates in its lists, but a pair must then share more of the prefix before it is verified. The estimated cost
of both decides (:func:`prefix`). For a pair of documents with l and l' the lesser holds.

What a pair must share follows from both sizes: if it shares c of the prefixes, its sets share at most c and what the
prefixes leave of the one that has more left, and that must reach the overlap which the threshold asks of both sizes.
Pairs that have only a passage in common fall out here.

Steps, each a table in the shared folder:

1. ``frequent``: counts of shingles over all documents, kept for those held often (an ordering hint: any list is right).
2. ``signed``: each document's size, set id and prefix.
3. ``shared``: prefix shingles that documents with different sets hold. Copies have one set id and so no links to make.
4. Short lists: all pairs are counted, and those that share enough are verified.
5. Stars: in each long list all sets are compared with a few centres instead of with one another. What a group of
   near copies needs is so in proportion to its size. The verified links give first components.
6. The rest: pairs of sets that are in one long list but not yet in one component. In a list, only sets outside its
   largest component pair up with all others. Those that share enough of their prefixes are verified.
7. Components of all links; each document gets the least doc_id of its own.

Verification is exact: whole sets are intersected. No list, group or candidate is capped.

A document without words has no shingles and links to nothing. Rows with a null id link like others; their component is the least id
that links reach, null if there is none. Rows with one id and different texts are separate rows; repeated rows are copies. A text of
any length is one set, held by one worker. Ties: where two orders or centres are as good, hashes decide. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, helper, partitions_for, table
from gridloom.llm.components import grown, outside_largest, still_open
from gridloom.llm.shingles import set_id, shingles

THRESHOLD = 75  # per cent
#: A shingle in this many documents is frequent; the list keeps the most frequent, up to a bound (12 bytes each).
FREQUENT = 12
FREQUENT_MOST = 1 << 19
#: Shingles are counted by their upper 40 bits.
_FP_SHIFT, _FP_BITS = np.uint64(24), 40
#: Bits of the number of ranges in which they are counted: enough for two ranges a shuffle partition, within these bounds.
_RANGE_BITS = (8, 20)
#: Sets that a task remembers so as to send the prefix of copies once.
SEEN_SETS = 200_000
MAX_MATCHES = 4
#: Cost of verifying a candidate in units of reading one list entry.
VERIFY_COST = 40.0
#: Lists of up to this many sets are paired up in full; longer ones go by stars first.
SHORT_LIST = 24
#: Rounds of stars, with two centres a list each, before all remaining pairs are taken.
STAR_ROUNDS = 2


#: Rows that a worker has in hand at once.
ROWS_AT_ONCE = 512
#: Shingles that a worker gathers before it sends their counts on.
SHINGLES_AT_ONCE = 1_000_000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(start, ROWS_AT_ONCE)


def _texts(b: pa.RecordBatch, column: str) -> list[bytes | None]:
    return b.column(column).cast(pa.large_binary()).to_pylist()


def frequent_shingles(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Upper 40 bits of the most frequent shingles, ascending, with the number of documents that hold each.

    Tasks send packed runs instead of rows: for each range of shingles, the sorted lower parts, and the counts
    of those that the task met more than once. A frequent shingle so takes eight bytes a task, however many rows have it.
    There are as many ranges as shuffle partitions, twice over at least: a range is no more than a partition's share.
    """
    bits = min(_RANGE_BITS[1], max(_RANGE_BITS[0], (2 * partitions_for(docs.sparkSession) - 1).bit_length()))
    low_bits = _FP_BITS - bits

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            fp, n = np.unique(np.concatenate(held) >> _FP_SHIFT, return_counts=True)
            cuts = np.searchsorted(fp, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(low_bits))
            low = (fp & np.uint64((1 << low_bits) - 1)).astype("<u4")
            rows = [(k, low[a:z].tobytes(), low[a:z][n[a:z] > 1].tobytes(), (n[a:z][n[a:z] > 1] - 1).astype("<u4").tobytes()) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["range", "once", "more", "extra"])

        for b in _slices(batches):
            for text in _texts(b, text_col):
                s = shingles(text)
                held.append(s)
                size += len(s)
                if size > SHINGLES_AT_ONCE:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def counted(t: pa.Table) -> pa.Table:
        once = np.frombuffer(b"".join(t["once"].to_pylist()), "<u4")
        more = np.frombuffer(b"".join(t["more"].to_pylist()), "<u4")
        extra = np.frombuffer(b"".join(t["extra"].to_pylist()), "<u4")
        fp, n = np.unique(once, return_counts=True)
        n = n.astype(np.int64)
        np.add.at(n, np.searchsorted(fp, more), extra)
        often = n >= FREQUENT
        high = np.int64(t["range"][0].as_py()) << low_bits
        return pa.table({"fp": fp[often].astype(np.int64) + high, "n": n[often]})

    runs = docs.select(text_col).mapInArrow(packed, "range int, once binary, more binary, extra binary")
    found = runs.groupBy("range").applyInArrow(counted, "fp long, n long")
    # Of a bounded size: FREQUENT_MOST rows of two numbers.
    top = found.orderBy(F.desc("n"), "fp").limit(FREQUENT_MOST).toArrow()
    fp, n = top["fp"].to_numpy().astype(np.uint64), top["n"].to_numpy()
    order = np.argsort(fp)
    return fp[order], n[order]


def prefix(s: np.ndarray, fp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of a set and the number of its shingles that a partner must share."""
    if not len(s):
        return s, 1
    base = len(s) - -(-THRESHOLD * len(s) // 100) + 1
    longest = min(len(s), base + MAX_MATCHES - 1)
    if len(fp):
        at = np.minimum(np.searchsorted(fp, s >> _FP_SHIFT), len(fp) - 1)
        held = fp[at] == s >> _FP_SHIFT
    else:
        held = np.zeros(len(s), bool)
    first = s[~held][:longest]
    if len(first) >= base:
        return first[:base], 1  # rare shingles: their lists are short, and one match is enough to look
    rest, often = s[held], n[at[held]]
    order = np.lexsort((rest, s[held] >> _FP_SHIFT, often))[: longest - len(first)]
    whole, lists = np.concatenate([first, rest[order]]), np.concatenate([np.zeros(len(first)), often[order] - 1.0])
    costs = []
    for m in range(1, len(whole) - base + 2):
        entries = lists[: base + m - 1].sum()
        costs.append(entries * (1 + VERIFY_COST / m**2))
    m = int(np.argmin(costs)) + 1
    return whole[: base + m - 1], m


def _row_key(id_col: str, text_col: str) -> Column:
    """What tells rows of a table apart, but for repeated ones."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def _signed(docs: DataFrame, fp: np.ndarray, n: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, n, cls, matches, prefix of every row; of copies that a task meets, the first has the prefix."""
    lists = docs.sparkSession.sparkContext.broadcast((fp, n))  # FREQUENT_MOST entries at most

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fp, n), seen = lists.value, set()
        for b in _slices(batches):
            rows = []
            for text in _texts(b, "t"):
                s = shingles(text)
                p, m = prefix(s, fp, n)
                cls = set_id(s)
                rows.append((len(s), cls, m, None if cls in seen else p.view(np.int64)))
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(cls)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("key"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "key", "n", "cls", "matches", "prefix"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), _row_key(id_col, text_col).alias("key"), F.col(text_col).alias("t"))
    return rows.mapInArrow(sign, "doc_id long, key long, n long, cls long, matches int, prefix array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, tokens) of the rows in wanted (key), each set once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            found = {set_id(s): s.view(np.int64) for s in map(shingles, _texts(b, "t"))}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["cls", "tokens"])

    rows = docs.select(_row_key(id_col, text_col).alias("key"), F.col(text_col).alias("t")).join(wanted.hint("merge"), "key", "left_semi")
    return rows.select("t").mapInArrow(read, "cls long, tokens array<long>").dropDuplicates(["cls"])


def _fits(a: str, b: str) -> Column:
    """Whether sizes alone leave the threshold in reach."""
    return 100 * F.least(a, b) >= THRESHOLD * F.greatest(a, b)


#: Columns that a pair has of each of its sets: shingles, matches it asks for, entries in long lists.
_OF_SET = ("n", "matches", "h")


def _need() -> Column:
    """The number of shared prefix shingles without which a pair (nx, matchesx, ny, matchesy) cannot reach the threshold."""
    left = lambda k: F.expr(f"greatest(0, ({THRESHOLD} * n{k} + 99) div 100 - matches{k})")
    overlap = F.expr(f"({THRESHOLD} * (nx + ny) + {99 + THRESHOLD}) div {100 + THRESHOLD}")
    return F.greatest(overlap - F.greatest(left("x"), left("y")), F.least("matchesx", "matchesy").cast("long"))


def _side(rows: DataFrame, k: str, *more: str) -> DataFrame:
    return rows.select("token", *(F.col(c).alias(c + k) for c in ("cls", *_OF_SET, *more)))


def _counted(met: DataFrame) -> DataFrame:
    """Pairs (a, b) with c, the lists they met in, and what each side is, from one row a meeting."""
    flip = F.col("clsx") > F.col("clsy")
    ends = [F.when(flip, F.col("clsy")).otherwise(F.col("clsx")).alias("a"), F.when(flip, F.col("clsx")).otherwise(F.col("clsy")).alias("b")]
    sides = [F.when(flip, F.col(c + o)).otherwise(F.col(c + k)).alias(c + k) for c in _OF_SET for k, o in (("x", "y"), ("y", "x"))]
    return met.select(*ends, *sides).groupBy("a", "b").agg(F.count("*").alias("c"), *(F.max(c + k).alias(c + k) for c in _OF_SET for k in "xy"))


def _short_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of sets that meet in short lists and may share enough, those in long lists included."""
    met = _side(lists, "x").join(_side(lists, "y"), "token").where((F.col("clsx") < F.col("clsy")) & _fits("nx", "ny"))
    return _counted(met).where(F.col("c") + F.least("hx", "hy") >= _need()).select("a", "b")


def _star_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """Sets with the two centres of each list, the sets of least and greatest hash.

    At first one hash holds for all lists: a group of near copies mostly has the same two centres, and pairs that
    meet often are taken. Later each list has centres of its own: what did not match the first is compared with many others.
    """
    of_set = F.struct("cls", *_OF_SET, "comp")
    h = F.xxhash64("cls", "token", F.lit(turn)) if turn else F.xxhash64("cls")
    ends = lists.groupBy("token").agg(F.min_by(of_set, h).alias("lo"), F.max_by(of_set, h).alias("hi"))
    met = _side(lists, "x", "comp").join(ends, "token").withColumn("y", F.explode(F.array("lo", "hi")))
    met = met.select("clsx", *(c + "x" for c in _OF_SET), *(F.col(f"y.{c}").alias(c + "y") for c in ("cls", *_OF_SET)), (F.col("compx") != F.col("y.comp")).alias("open"))
    met = met.where(F.col("open") & _fits("nx", "ny") & (_need() <= F.least("hx", "hy")))
    # A quarter of what a pair needs in all is enough at first: pairs that stars leave out come up again in the rest.
    return _counted(met).where(F.lit(turn > 0) | (4 * F.col("c") >= _need())).select("a", "b")


def _open_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of sets in different components that meet in long lists and may share enough.

    Both have all they share in lists that are open. A pair that needs k matches has k - 1 more behind the first, so its
    first meeting, in the order of shingles, is where both sets have k entries left; later meetings are not looked at.
    """
    left = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("token")))  # at most a prefix's entries a set
    rows = outside_largest(lists.withColumn("left", left))
    x, y = _side(rows.where(~F.col("in_most")), "x", "comp", "left"), _side(rows, "y", "comp", "left", "in_most")
    # Both outside the largest component: such a pair comes up from either side, so one side is enough.
    met = x.join(y, "token").where((F.col("compx") != F.col("compy")) & (F.col("in_mosty") | (F.col("clsx") < F.col("clsy"))) & _fits("nx", "ny") & (_need() <= F.least("leftx", "lefty")))
    return met.select(F.least("clsx", "clsy").alias("a"), F.greatest("clsx", "clsy").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that reach the threshold."""
    of = lambda k: sets.select(F.col("cls").alias(k), F.col("tokens").alias(f"t{k}"))
    common = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(of("b"), "b").join(of("a"), "a").where(100 * common >= THRESHOLD * (F.size("ta") + F.size("tb") - common)).select("a", "b")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: doc_id, key, n (size of its set) and root, the same for all sets that links connect."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram_join")
    fp, n = frequent_shingles(docs, text_col)
    signed = scratch.keep(_signed(docs, fp, n, id_col, text_col), "signed")
    members = scratch.keep(signed.select("doc_id", "key", "n", "cls"), "members")

    # Both uses of the entries read one exchange; copies have sent one prefix a task.
    entries = signed.where("prefix is not null").select("cls", F.explode("prefix").alias("token")).repartition(partitions_for(spark), "token").distinct()
    lengths = entries.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
    shared = scratch.keep(entries.join(lengths, "token"), "shared_ids")
    classes = signed.groupBy("cls").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.max("matches").alias("matches"))
    held = shared.groupBy("cls").agg(F.count_if(F.col("length") > SHORT_LIST).alias("h"))
    classes = scratch.keep(classes.join(held, "cls"), "classes")
    scratch.drop("signed")
    shared = scratch.keep(shared.join(classes.drop("key"), "cls"), "shared")
    scratch.drop("shared_ids")
    pairs = scratch.keep(_short_pairs(shared.where(F.col("length") <= SHORT_LIST)), "short_pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("cls")).union(classes.where("h > 0").select("cls")).distinct()
    sets = scratch.keep(_sets(docs, classes.join(used, "cls", "left_semi").select("key"), id_col, text_col), "sets")

    lists = shared.where(F.col("length") > SHORT_LIST).withColumn("comp", F.col("cls"))
    done = None
    for turn in range(STAR_ROUNDS):
        met = _star_pairs(lists, turn)
        found = scratch.keep(_verified(met if turn else met.union(pairs).distinct(), sets), f"links_{turn}")
        done = grown(done, found, scratch, f"comp_{turn}")
        lists = scratch.keep(still_open(lists, done, "cls"), f"open_{turn}")
        scratch.drop(f"open_{turn - 1}")
        if lists.isEmpty():
            break
    else:
        done = grown(done, scratch.keep(_verified(_open_pairs(lists), sets), "links_rest"), scratch, "comp_rest")
    root = done.select(F.col("node").alias("cls"), "root")
    out = scratch.keep(members.join(root, "cls", "left").select("doc_id", "key", "n", F.coalesce("root", "cls").alias("root")), "grouped")
    scratch.drop("shared", "sets", "classes", "members", "short_pairs", f"open_{turn}")
    return out


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    rows = _grouped(docs, id_col, text_col)
    least = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return rows.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), component)


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each component the row with the least id stays (no id: the last), with all its columns.

    Rows of one id and different texts are different documents. Rows that are alike in id and text are one. A document without words stays.
    """
    rows, key = _grouped(docs, id_col, text_col), helper("key")
    first = rows.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    keep = first.select(F.col("first.key").alias(key)).union(rows.where("n = 0").select("key")).distinct()
    return docs.withColumn(key, _row_key(id_col, text_col)).join(keep, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reached r USING (doc_id) LEFT JOIN sizes s USING (doc_id)
GROUP BY d.doc_id
"""
