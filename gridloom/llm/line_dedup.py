"""Fuzzy line dedup by MinHash.

A line is what stands between line feeds, without white space at its ends; blank lines stay as they are. Lines are compared
as sets of their runs of eight characters (a shorter line is one run). Two lines whose Jaccard similarity is 0.75 or more are
linked, and of each component of links one line stays, the one with the least (doc_id, hash of the text, row, line number); a
null id comes first.

1. Each line gets a one-permutation MinHash signature: its runs are hashed and dealt into 64 bins, each bin
   keeps the least, and an empty bin takes over that of the next full one. Sixteen bands of four bins are looked up: two lines at
   0.75 meet in one with probability 0.998, at 0.85 with 0.99999.
2. Equal lines are one node. In each band list all lines are compared with one centre, the commonest line, which leaves the list
   then, as all its pairs there are decided. The others are compared each with the next one in two orders, by other bands. What is
   then still in different components is paired up across components, each pair where its first equal band is.
3. Pairs whose sizes rule the threshold out are left out, and so are those whose parity maps do: a run switches one of 1,024 bits,
   so two lines have at least as many runs apart as bits, and no link is lost. Where both lines have more than a thousand runs, which
   the maps tell less of, finer MinHash sketches must not agree in far fewer bins than 0.75 lets expect (three deviations). All others
   are verified by their exact similarity. Verified links go through distributed union-find.

Null and empty texts have no lines. Each row of the table is judged by itself, whether or not others have its id or its text: of
equal rows one keeps its lines. A line of any length is one line. Columns besides id and text are carried along. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, helper, partitions_for, table
from gridloom.llm.components import grown, outside_largest, still_open

THRESHOLD = 75  # per cent
RUN = 8
BINS, ROWS = 64, 4
BANDS = BINS // ROWS
#: Orders of neighbours: from which band behind a list's own on.
NEXT_BANDS = (1, 6)
#: Bits of a bin in a signature. A band is one 64-bit number: its bins, side by side.
BIN_BITS = 15
#: Lines that meet in a band have a parity map as well, of 64 bits to a word.
MAP_WORDS = 16
#: Lines of more runs have a finer sketch too: 240 bins of three bits, 15 to a number, each with a bit to spare.
SKETCH_FROM = 1000
SKETCH_BITS, SKETCH_LANES, SKETCH_WORDS = 3, 15, 16
SKETCH_BINS = SKETCH_LANES * SKETCH_WORDS
_GUARDS = sum(8 << 4 * k for k in range(SKETCH_LANES))
_FULL = sum(7 << 4 * k for k in range(SKETCH_LANES))
#: Bits of the filter that picks the lines whose texts are fetched: 8 MB at any size. Where it is full it passes lines that a join then sorts out.
FILTER_BITS = 26
#: Characters of different lines that a worker signs at once, and rows it has in hand.
CHARS_AT_ONCE, BLOCK_CHARS = 1_000_000, 30_000
ROWS_AT_ONCE = 256
#: What tells of two lines whether they may link.
FACTS = ("n", "agree", "map", "sketch")
_ODD = 0x9E3779B97F4A7C15
_PROBES = (3, 33)
_SPACES = " \t\n\r\x0b\x0c"


def _folded(c: np.ndarray, odd: int, shift: int) -> np.ndarray:
    """Hashes of the runs of eight characters in c: of pairs, then of pairs of those, then of these."""
    z, odd, shift = c, c.dtype.type(odd), c.dtype.type(shift)
    for k in (1, 2, 4):
        z = z[:-k] * odd + z[k:]
        z ^= z >> shift
    z *= odd
    z ^= z >> shift
    return z


def _codes(lines: Iterable[str]) -> np.ndarray:
    return np.frombuffer("".join(lines).encode("utf-32-le", "replace"), "<u4")


def _filled(line: str) -> str:
    """A short line is filled up with what no line has, so that it is one run."""
    return line if len(line) >= RUN else line.ljust(RUN, "\n")


def runs(line: str) -> np.ndarray:
    """Hashes of a line's runs of eight characters, one for each place."""
    return _folded(_codes([_filled(line)]).astype(np.uint64), _ODD, 31)


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) - (1 << 63)


@lru_cache(maxsize=4096)
def run_set(line: str) -> np.ndarray:
    """The distinct runs of a line, ascending."""
    z = runs(line)
    z.sort()
    return z[np.concatenate([[True], z[1:] != z[:-1]])]


def _least(lines: list[str], bins: int) -> np.ndarray:
    """For each line and bin the least hash of the runs dealt to it; an empty bin has the next full one's, with the distance mixed in."""
    n, size = len(lines), np.fromiter(map(len, lines), np.int64, len(lines))
    hashed = _folded(_codes(lines), _ODD & 0xFFFFFFFF, 15)
    slot = np.repeat(np.arange(0, n * bins, bins), size)[: len(hashed)]
    slot += ((hashed >> np.uint32(16)) * np.uint32(bins) >> np.uint32(16)).astype(np.int64)
    # Runs that go on into the next line, the last seven places of each line, belong to none.
    slot[(np.cumsum(size)[:-1, None] - np.arange(1, RUN)).ravel()] = n * bins
    none = np.uint32(0xFFFFFFFF)
    least = np.full(n * bins + 1, none, np.uint32)
    np.minimum.at(least, slot, (hashed * np.uint32(0x85EBCA6B)) & ~np.uint32(1))
    least = least[:-1].reshape(n, bins)
    place = np.where(least != none, np.arange(bins), 4 * bins)
    ahead = np.minimum.accumulate(np.concatenate([place, place + bins], 1)[:, ::-1], 1)[:, ::-1][:, :bins]
    mixed = np.take_along_axis(least, ahead % bins, 1).astype(np.uint64) + ((ahead - np.arange(bins)).astype(np.uint64) << np.uint64(32))
    return mixed * np.uint64(_ODD)


def _packed(least: np.ndarray, words: int, bits: int, stride: int) -> np.ndarray:
    """The first bits of each bin, as many bins to a number as there are to a word."""
    few = (least >> np.uint64(64 - bits)).reshape(len(least), words, -1)
    z = np.zeros((len(least), words), np.uint64)
    for k in range(few.shape[2]):
        z |= few[:, :, k] << np.uint64(stride * k)
    return z.view(np.int64)


def _by_blocks(lines: list[str], f: Callable[[list[str]], np.ndarray]) -> np.ndarray:
    """f of the lines, as many at once as have some BLOCK_CHARS characters."""
    found, block, size = [], [], 0
    for line in map(_filled, lines):
        block.append(line)
        size += len(line)
        if size > BLOCK_CHARS:
            found.append(f(block))
            block, size = [], 0
    return np.concatenate([*found, f(block)] if block or not found else found)


def signatures(lines: list[str]) -> np.ndarray:
    """The sixteen bands of each line."""
    return _by_blocks(lines, lambda x: _packed(_least(x, BINS), BANDS, BIN_BITS, BIN_BITS)) if lines else np.zeros((0, BANDS), np.int64)


def sketches(lines: list[str]) -> np.ndarray:
    return _by_blocks(lines, lambda x: _packed(_least(x, SKETCH_BINS), SKETCH_WORDS, SKETCH_BITS, SKETCH_BITS + 1)) if lines else np.zeros((0, SKETCH_WORDS), np.int64)


def parity_maps(lines: list[str]) -> np.ndarray:
    """For each line, bits that each of its distinct runs switches once: two maps differ in no more bits than lines in runs."""
    width = 64 * MAP_WORDS
    sets = [run_set(x) for x in lines]
    slot = np.repeat(np.arange(0, len(lines) * width, width), [len(x) for x in sets])
    slot += (np.concatenate([*sets, np.zeros(0, np.uint64)]) % np.uint64(width)).astype(np.int64)
    return np.packbits(np.bincount(slot, minlength=len(lines) * width).astype(np.uint8) & 1).view(np.int64).reshape(-1, MAP_WORDS)


def lines_of(text: str | None) -> list[str]:
    return [x.strip(_SPACES) for x in (text or "").split("\n")]


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), pa.int64()))


def _signed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, h, row, text) by lines: (doc_id, h, row, no, line, sig), and one row without a line for a text that has none.

    Of equal lines that a worker has in hand at once, one carries the signature.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple] = []
        places: list[int] = []
        known: dict[str, int] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            texts = list(known)
            names = np.array([*map(line_id, texts), 0], np.int64)
            at = np.array(places, np.int64)
            none = at < 0
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            first &= ~none
            packed = signatures(texts).tobytes()
            sig = pa.array([packed[8 * BANDS * k : 8 * BANDS * (k + 1)] if f else None for k, f in zip(places, first, strict=True)], pa.binary())
            doc, h, row, no = zip(*keys, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(row, pa.int64()), pa.array(no, pa.int32()), pa.array(names[at], pa.int64(), mask=none), sig], ["doc_id", "h", "row", "no", "line", "sig"]
            )

        for b in batches:
            for start in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(start, ROWS_AT_ONCE)
                for doc, h, row, text in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    found = [(no, line) for no, line in enumerate(lines_of(text)) if line]
                    for no, line in found or [(None, None)]:
                        keys.append((doc, h, row, no))
                        if line is not None and line not in known:
                            known[line] = len(known)
                            size += len(line)
                        places.append(-1 if line is None else known[line])
                    if size > CHARS_AT_ONCE or len(keys) > CHARS_AT_ONCE // 16:
                        yield flush()
                        keys, places, size = [], [], 0
                        known.clear()
        if keys:
            yield flush()

    return docs.mapInArrow(sign, "doc_id long, h long, row long, no int, line long, sig binary")


def _lists_of(signed: DataFrame) -> DataFrame:
    """(token, line, c) of the bands that two or more different lines of signed (line, sig) have; c: how often the line came.

    A token is a band's hash with the band's number in its last bits. Partitions are sorted by token and gone through once, with
    a batch and one entry in hand, so that a list of any length takes no memory.
    """
    tokens = F.array(*[F.expr(f"(xxhash64(substring(sig, {8 * k + 1}, 8)) & -{BANDS}L) | {k}L") for k in range(BANDS)])
    entries = signed.select("line", F.explode(tokens).alias("token")).select("token", "line").repartition(partitions_for(signed.sparkSession), "token")

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last token so far; its one line and how often it came, if no other line has it yet.
        last, pending = None, None

        for b in batches:
            token, line = (b.column(k).to_numpy() for k in ("token", "line"))
            if not len(token):
                continue
            c = np.ones(len(token), np.int64)
            known = last == token[0] and pending is None
            if pending is not None:
                token, line, c = (np.concatenate([[x], y]) for x, y in zip((last, *pending), (token, line, c), strict=True))
            same = token[1:] == token[:-1]
            # Only tokens that come again; equal lines of a token are put together.
            at = np.flatnonzero(np.concatenate([[known], same]) | np.concatenate([same, [True]]) | (known & (token == token[0])))
            at = at[np.lexsort((line[at], token[at]))]
            token, line, c = token[at], line[at], c[at]
            starts = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (line[1:] != line[:-1])]))
            token, line, c = token[starts], line[starts], np.add.reduceat(c, starts)
            same = token[1:] == token[:-1]
            shared = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (known & (token == last))
            last, pending = token[-1], None if shared[-1] else (line[-1], c[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[shared]) for x in (token, line, c)], ["token", "line", "c"])

    found = entries.sortWithinPartitions("token").mapInArrow(several, "token long, line long, c long")
    return found.groupBy("token", "line").agg(F.sum("c").alias("c"))  # of a list that goes over batches, a line may come twice


def _filter_of(lines: DataFrame) -> np.ndarray:
    """A Bloom filter of lines (line), of 2**FILTER_BITS bits: as many 64-bit words come to the driver at most."""
    slots = lines.select(F.explode(F.array(*[F.expr(f"(line >> {s}) & {(1 << FILTER_BITS) - 1}L") for s in _PROBES])).alias("s"))
    words = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS int))")).alias("b")).toArrow()
    found = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    found[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return found


def _texts(docs: DataFrame, used: DataFrame) -> DataFrame:
    """(line, words) for every line of docs that used (line) holds."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(used))  # 8 MB

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = shared.value, np.int64((1 << FILTER_BITS) - 1)
        for b in batches:
            found = list({x for t in b.column(0).to_pylist() for x in lines_of(t) if x})
            names = np.fromiter(map(line_id, found), np.int64, len(found))
            held = np.ones(len(found), bool)
            for k in _PROBES:
                slot = (names >> np.int64(k)) & mask
                held &= (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield pa.RecordBatch.from_arrays([pa.array(names[held]), pa.array([x for x, h in zip(found, held, strict=True) if h], pa.large_string())], ["line", "words"])

    found = docs.select("text").mapInArrow(read, "line long, words string")
    return found.join(used.hint("shuffle_hash"), "line", "left_semi").dropDuplicates(["line"])


def _measured(lines: DataFrame) -> DataFrame:
    """lines (line, words) with n, the distinct runs, agree, the equal bins that a partner's sketch must have, sig, map and sketch (null up to SKETCH_FROM runs)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(start, ROWS_AT_ONCE)
                words = part.column("words").to_pylist()
                n = np.array([len(run_set(x)) for x in words], np.int64)
                long = n > SKETCH_FROM
                fine = iter(sketches([x for x, k in zip(words, long, strict=True) if k]))
                sketch = pa.array([next(fine).tolist() if k else None for k in long], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(n, pa.int32()), pa.array(least_agreement(n), pa.int32()), _lists(signatures(words)), _lists(parity_maps(words)), sketch],
                    ["line", "words", "n", "agree", "sig", "map", "sketch"],
                )

    return lines.select("line", "words").mapInArrow(measure, "line long, words string, n int, agree int, sig array<long>, map array<long>, sketch array<long>")


def least_agreement(n: np.ndarray) -> np.ndarray:
    """Equal bins that two lines at the threshold have with three deviations to spare, of lines of n runs: fewer runs fill fewer bins."""
    share = THRESHOLD / 100 + (1 - THRESHOLD / 100) / (1 << SKETCH_BITS)
    return np.ceil(SKETCH_BINS * (share - 3 * np.sqrt(share * (1 - share) / np.minimum(SKETCH_BINS, np.maximum(n, 1))))).astype(np.int64)


def _may_link(x: str, y: str) -> Column:
    """Whether lines x and y (the columns FACTS with these suffixes) have sizes, maps and sketches that a link can have."""
    apart = " + ".join(f"bit_count(map{x}[{k}] ^ map{y}[{k}])" for k in range(MAP_WORDS))
    unequal = " + ".join(f"bit_count(((sketch{x}[{k}] ^ sketch{y}[{k}]) + {_FULL}L) & {_GUARDS}L)" for k in range(SKETCH_WORDS))
    return F.expr(
        f"100 * least(n{x}, n{y}) >= {THRESHOLD} * greatest(n{x}, n{y}) AND {100 + THRESHOLD} * ({apart}) <= {100 - THRESHOLD} * (n{x} + n{y}) "
        f"AND coalesce({SKETCH_BINS} - ({unequal}) >= least(agree{x}, agree{y}), true)"
    )


def _possible(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) that may link."""
    of = lambda k: lines.select(F.col("line").alias(k), *(F.col(c).alias(c + k) for c in FACTS))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(_may_link("a", "b")).select("a", "b")


def _verified(may: DataFrame, lines: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link, by their exact similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("wa").to_pylist(), b.column("wb").to_pylist(), strict=True):
                p, q = run_set(x), run_set(y)
                both = np.concatenate([p, q])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * common >= THRESHOLD * (len(both) - common))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    of = lambda k: lines.select(F.col("line").alias(k), F.col("words").alias(f"w{k}"))
    return may.join(of("a"), "a").join(of("b"), "b").select("a", "b", "wa", "wb").mapInArrow(verify, "a long, b long")


def _around_centres(lists: DataFrame) -> DataFrame:
    """(token, line, y): each line of a list but its centre y, the line that most slices of the table hold."""
    by = F.expr(f"shiftleft(least(c, {1 << 20}), 40) + (line & {(1 << 40) - 1}L)")
    return lists.join(lists.groupBy("token").agg(F.max_by("line", by).alias("y")), "token").where("line <> y").select("token", "line", "y")


def _star_pairs(around: DataFrame) -> DataFrame:
    """Each line with the centre of each of its lists."""
    return around.select(F.least("line", "y").alias("a"), F.greatest("line", "y").alias("b")).distinct()


def _neighbour_pairs(lists: DataFrame, lines: DataFrame) -> DataFrame:
    """Each line with the next one of another component in each of its lists, which is ordered by two bands behind its own, from each of NEXT_BANDS on: what is next has most in common."""
    band = lambda k: F.element_at("sig", F.pmod(F.col("token") + F.lit(k), F.lit(BANDS)).cast("int") + 1)
    orders = [c for k in NEXT_BANDS for c in (band(k).alias(f"p{k}"), band(k + 1).alias(f"q{k}"))]
    rows = lists.join(lines.select("line", "sig"), "line").select("token", "line", "comp", *orders)
    at = [Window.partitionBy("token").orderBy(f"p{k}", f"q{k}", "line") for k in NEXT_BANDS]
    after = [F.lead(F.struct(F.col("line").alias("y"), F.col("comp").alias("compy"))).over(w) for w in at]
    both = rows.select("line", "comp", F.array(*after).alias("after")).select("line", "comp", F.explode("after").alias("z"))
    met = both.select("line", "comp", "z.*").where("comp <> compy")
    return met.select(F.least("line", "y").alias("a"), F.greatest("line", "y").alias("b")).distinct()


def _open_pairs(lists: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs of different components that meet in a list and may link, each once: in its first equal band."""
    rows = outside_largest(lists).join(lines.select("line", "sig", *FACTS), "line")
    side = lambda df, k: df.select("token", *(F.col(c).alias(c + k) for c in ("line", "comp", "in_most", "sig", *FACTS)))
    first = "CASE " + " ".join(f"WHEN sigx[{k}] = sigy[{k}] THEN {k}" for k in range(BANDS)) + " END"
    met = side(rows.where("not in_most"), "x").join(side(rows, "y"), "token").where("compx <> compy AND (in_mosty OR linex < liney)")
    return met.where(F.expr(f"100 * least(nx, ny) >= {THRESHOLD} * greatest(nx, ny) AND (token & {BANDS - 1}L) = {first}") & _may_link("x", "y")).select(F.least("linex", "liney").alias("a"), F.greatest("linex", "liney").alias("b"))


def _linked(found: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The components (node, root) of the lines in found."""
    lists = scratch.keep(_lists_of(found.where("sig is not null")), "lists")
    lines = scratch.keep(_measured(_texts(docs, lists.select("line").distinct())), "texts")

    around = scratch.keep(_around_centres(lists), "around")
    done = grown(None, scratch.keep(_verified(_possible(_star_pairs(around), lines), lines), "links_star"), scratch, "comp_star")
    # Every pair with a centre is decided by now, so that lists go on without theirs, and a list of two lines is done.
    rest = scratch.keep(still_open(around.select("token", "line"), done, "line"), "open")
    done = grown(done, scratch.keep(_verified(_possible(_neighbour_pairs(rest, lines), lines), lines), "links_next"), scratch, "comp_next")
    rest = scratch.keep(still_open(rest, done, "line"), "open_next")
    return grown(done, scratch.keep(_verified(_open_pairs(rest, lines), lines), "links_rest"), scratch, "comp_rest")


def _contested(found: DataFrame, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows of found whose line comes again or is linked, with component; and of each component the row (doc_id, h, row, no) that stays."""
    done = _linked(found, docs, scratch).select(F.col("node").alias("line"), "root")
    counts = found.where("line is not null").groupBy("line").agg(F.count("*").alias("c"))
    lines = counts.join(done, "line", "left").where("c > 1 OR root is not null").select("line", F.coalesce("root", "line").alias("component"))
    rows = scratch.keep(found.drop("sig").join(lines.hint("shuffle_hash"), "line"), "contested")
    return rows, rows.groupBy("component").agg(F.min(F.struct("doc_id", "h", "row", "no")).alias("first")).select("component", "first.*")


def _lost(rows: DataFrame, first: DataFrame) -> DataFrame:
    """(row, lost): the numbers of the lines that go, by row of the table, ascending."""
    both = rows.select("row", "no", F.lit(None).cast("int").alias("stays")).union(first.select("row", F.lit(None).cast("int"), "no"))
    lost = both.groupBy("row").agg(F.collect_list("no").alias("nos"), F.collect_list("stays").alias("stay"))
    return lost.select("row", F.array_sort(F.array_except("nos", "stay")).alias("lost"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), row.alias("row"), F.col(text_col).alias("text"))


def judge_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a line that is not blank: doc_id, h (hash of the row's text), row (its number), no, line (its id), component, kept."""
    scratch, docs = Scratch(docs.sparkSession, "line_dedup"), _keyed(docs, id_col, text_col, F.monotonically_increasing_id())
    found = scratch.keep(_signed(docs), "lines")
    rows, first = _contested(found, docs, scratch)
    judged = rows.select("row", "no", "component").join(first.select("row", "no", F.lit(True).alias("kept")), ["row", "no"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    out = found.where("line is not null").join(judged, ["row", "no"], "left")
    return out.select("doc_id", "h", "row", "no", "line", F.coalesce("component", "line").alias("component"), F.coalesce("kept", F.lit(True)).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with only the lines that are kept; blank lines and all other columns stay."""
    scratch, row, gone = Scratch(docs.sparkSession, "line_dedup"), helper("row"), helper("gone")
    # Rows are numbered once: two runs of one plan may number them differently.
    numbered = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    keyed = _keyed(numbered, id_col, text_col, F.col(row))
    lost = _lost(*_contested(scratch.keep(_signed(keyed), "lines"), keyed, scratch)).select(F.col("row").alias(row), F.col("lost").alias(gone))
    left = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, k: ~F.array_contains(gone, k)), "\n")
    return numbered.join(lost, row, "left").withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its lines that are not blank, how many stay, and the numbers of those that go."""
    scratch, docs = Scratch(spark, "line_dedup"), _keyed(table(spark, sf_dir, "documents"), "doc_id", "text", F.monotonically_increasing_id())
    found = scratch.keep(_signed(docs), "lines")
    lost = _lost(*_contested(found, docs, scratch))
    out = found.groupBy("row", "doc_id").agg(F.count("no").alias("n_lines")).join(lost, "row", "left")
    dropped = F.coalesce("lost", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size(dropped)).alias("n_kept"), dropped.alias("dropped"))
