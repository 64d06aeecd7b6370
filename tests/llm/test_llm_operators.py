import collections
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import components, decontaminate, language_id, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, sharding, token_store, url_filters
from gridloom.llm import queries as llm_queries
from gridloom.llm.common import Scratch
from llm_cases import ODD, SCHEMA, docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- components


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.root for r in components.components(df, scratch, "c").collect()} == {x: find(x) for x in parent}
    half = components.grown(None, df.limit(90), scratch, "x")
    assert {r.node: r.root for r in components.grown(half, df, scratch, "y").collect()} == {x: find(x) for x in parent}
    assert components.components(df.limit(0), scratch, "z").count() == 0


# ---- 1: tokens


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_word_encoder_equals_the_library(tokenizer):
    path, library = tokenizer
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    e, r = token_store.WordEncoder(spec), random.Random(3)
    assert token_store.word_safe(json.loads(spec)) and isinstance(token_store.encoder_of(path), token_store.WordEncoder)
    assert not token_store.word_safe(json.loads(spec.replace("[\\\\p{L}]+", "[\\\\p{L}.]+")))  # another cut is another kind
    whole = token_store.TextEncoder(spec)
    letters = "aB's'S \t\n\x0b\x1c\x85\xa0é́ñÑ×÷ß.,-()]#*$%&|<>0129²Ⅷſİςσ漢か\U0001f642‍؀"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 25))) for _ in range(3000)]
    texts += ["", " ", "it's I'LL 's", "<|endoftext|>x <|startoftext|> a<|endoftext|>b", prose(5, 500)]
    for t in texts:
        assert np.frombuffer(e.encode(t.encode()), e.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert whole.encode(t.encode()) == e.encode(t.encode())


def test_token_store(spark, tokenizer, tmp_path):
    path, library = tokenizer
    rows = [*ODD, *((100 + k, prose(k, 40)) for k in range(60))]
    token_store.write_store(docs(spark, rows), str(tmp_path / "s"), path)
    got = token_store.read_store(spark, str(tmp_path / "s")).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(r.doc_id is not None, r.doc_id or 0) for r in got]
    want = collections.Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += len(r.ids)
    few = token_store.read_documents(spark, str(tmp_path / "s"), [101, 6, 999]).collect()
    assert sorted(r.doc_id for r in few) == [6, 6, 6, 101]
    token_store.write_store(empty(spark), str(tmp_path / "e"), path)
    assert token_store.read_store(spark, str(tmp_path / "e")).count() == 0
    assert not token_store.word_safe({"pre_tokenizer": {"type": "ByteLevel"}, "model": {}})


def test_token_store_of_another_tokenizer(spark, tmp_path):
    """Any tokenizer of the library: whole texts, white space and all."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [*ODD, (100, "two  spaces\n\nand lines ")]
    token_store.write_store(docs(spark, rows), str(tmp_path / "s"), path, end_id=50256)
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in token_store.read_store(spark, str(tmp_path / "s")).collect())
    assert got == collections.Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [50256])) for i, t in rows)


# ---- 2: language


def test_language(spark):
    r = random.Random(2)
    vocab = {"xx": [w for w in prose(11, 300).split()], "yy": [w.translate(str.maketrans("abcdefghij", "qrstuvwxyz")) for w in prose(12, 300).split()]}
    text = lambda g: " ".join(r.choice(vocab[g]) for _ in range(80))
    rows = [(k, text(g), g, f"src{k % 3}") for k in range(60) for g in [("xx", "yy")[k % 2]]] + [(i, t, None, None) for i, t in ODD]
    page = lambda k, g, declared: (k, f"https://www.a{k % 2}.example.{g}/p", f'<html lang="{declared}"><body><p>{text(g)}</p></body></html>')
    pages = [page(k, g, g) for k in range(40) for g in [("xx", "yy")[k % 2]]] + [page(90, "xx", "yy"), (91, None, None), (92, "no scheme", ""), (93, "http://b.example.yy", "<html></html>")]
    train = docs(spark, [x for x in rows if x[2] is not None and x[0] % 4 < 2])
    got = {(r.kind, r.id, r.lang) for r in language_id.identify(docs(spark, rows), spark.createDataFrame(pages, "page_id long, url string, html string"), train).collect()}
    for k, _, g, _ in rows[:60]:
        assert ("document", k, g) in got  # the half with k % 4 > 1 was held out
    assert all(("page", p[0], ("xx", "yy")[p[0] % 2]) in got for p in pages[:40])
    assert ("page", 90, "xx") in got  # the text outweighs a wrong declaration
    assert ("page", 93, "yy") in got  # no text: suffix and host decide
    none = language_id.identify(empty(spark), spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.count() == 0


def test_fusion_equals_a_plain_computation(spark):
    """Posteriors of pages against sums made row by row."""
    r, n, T = random.Random(5), 3, language_id.SMOOTHING
    rows = []
    for k in range(60):
        p = np.array([r.random() + 1e-3 for _ in range(n)])
        host = r.choice([None, "a.b.de", "c.b.de", "x.fr", "one"])
        rows.append(("page", k, host, r.choice([None, "de", "fr"]), np.log(p / p.sum()).tolist()))
    got = {x.id: x.post for x in language_id.fuse(spark.createDataFrame(rows, "kind string, id long, host string, declared string, lp array<double>"), n).collect()}
    w = {k: np.exp(x[4]) for k, x in enumerate(rows)}
    parent = lambda h: None if h is None else ".".join(h.split(".")[-2:])
    suffix = lambda h: None if h is None or "." not in h else h.split(".")[-1]
    for k, (_, _, host, declared, lp) in enumerate(rows):
        others = [j for j in w if j != k]
        sums = lambda test: sum((w[j] for j in others if test(rows[j])), np.zeros(n))
        log = np.array(lp)
        if host is None:
            log += np.log(1 / n)
        else:
            a = sums(lambda x: x[2] is not None)
            prior = (a + T / n) / (a.sum() + T)
            for level in (sums(lambda x: parent(x[2]) == parent(host)), sums(lambda x: x[2] == host)):
                prior = (level + T * prior) / (level.sum() + T)
            log += np.log(np.maximum(prior, 1e-12))
        for value, of in ((declared, lambda x: x[3]), (suffix(host), lambda x: suffix(x[2]))):
            if value is not None:
                v, t = sums(lambda x: of(x) == value), sums(lambda x: of(x) is not None)
                share = (v.sum() + 1e-3) / (t.sum() + 0.5)
                log += np.log((v + 0.5 * share + 1e-3) / (t + 0.5)) - math.log(share)
        post = np.exp(log - log.max())
        assert np.allclose(got[k], post / post.sum(), atol=1e-9), rows[k]


def test_language_declared_late_in_a_page(spark):
    rows = [(k, prose(k, 40), "en" if k % 2 else "de", "src0") for k in range(6)]
    late = "<!-- " + "licence " * 1000 + "-->\n<html class='a' lang='de'><body>" + prose(2, 40) + "</body></html>"
    pages = spark.createDataFrame([(1, "https://a.b.de/x", late), (2, "https://a.b.de/y", "<p>" + prose(2, 40))], "page_id long, url string, html string")
    got = {r.id: r.declared for r in language_id.identify(docs(spark, rows), pages).where("kind = 'page'").collect()}
    assert got == {1: "de", 2: None}


# ---- 3: leaks


def test_leaks(spark):
    items = [(k, prose(100 + k, 20 + 3 * k)) for k in range(6)] + [(20, "only three words"), (21, None), (22, "")]
    r, rows = random.Random(4), list(ODD)
    for k, t in items[:6]:
        w = t.split()
        rows.append((200 + k, prose(k, 40) + " " + t.upper() + ", " + prose(k + 50, 30)))
        v = list(w)
        v[r.randrange(len(v))] = "changed"
        rows.append((300 + k, prose(k, 10) + " " + " ".join(v) + " " + prose(k, 10)))
        rows.append((400 + k, " ".join(w[: len(w) // 2]) + " " + prose(k + 7, 30)))
    rows += [(500, "Only three, words!"), (501, "here are only three words"), (502, prose(77, 300))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.find_leaks(docs(spark, rows), bench).collect()}

    def shingled(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []

    weigh = lambda s: sum(len(x) for g in s for x in g)
    want = {}
    for i, t in rows:
        s = shingled(t)
        for k, u in items:
            a = set(shingled(u))
            for at in range(max(1, len(s) - len(shingled(u)) + 1)) if a and s else ():
                b = set(s[at : at + len(shingled(u))])
                if 100 * weigh(a & b) >= 75 * weigh(a | b):
                    want[i, k] = max(want.get((i, k), 0), weigh(a & b) / weigh(a | b))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)
    assert {(200 + k, k) for k in range(6)} <= got.keys() and (500, 20) in got and (501, 20) not in got
    left = decontaminate.clean_documents(docs(spark, rows), bench)
    assert left.columns == docs(spark, rows).columns and left.count() == len(rows) - len({i for i, _ in got})
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0 and decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_a_long_item_is_compared_whole(spark):
    """The end of an item of 1400 words is no leak; the item is one, and words of many letters weigh as they are."""
    words = prose(120, 1400).split()
    words[7], words[900] = "q" * 40, "z" * 300
    rows = [(1, " ".join(words[-400:]) + " " + prose(3, 50)), (2, prose(4, 30) + " " + " ".join(words) + " " + prose(5, 30)), (3, " ".join(words[:1300])), (4, " ".join(words[200:900]))]
    bench = spark.createDataFrame([(9, " ".join(words)), (9, "another item of that id")], "item_id long, text string")
    got = {r.doc_id: r.similarity for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()}
    assert got.keys() == {2, 3} and got[2] == 1.0


def test_fingerprints_of_passages_at_the_threshold_are_within_the_radius(spark):
    """Measured recall of the radius: windows of 30 to 90 words that are 0.75 to 0.8 alike."""
    r, pairs = random.Random(21), []
    while len(pairs) < 400:
        w = prose(r.randrange(10_000), r.randrange(30, 90)).split()
        v = list(w)
        for _ in range(r.randrange(1, 4)):
            v[r.randrange(len(v))] = "other" + str(r.randrange(99))
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (w, v))
        weigh = lambda s: sum(len(x) for g in s for x in g)
        if 0.75 <= weigh(a & b) / weigh(a | b) <= 0.8:
            pairs.append((len(pairs), " ".join(w), " ".join(v)))
    df = spark.createDataFrame(pairs, "item_id long, a string, b string")
    x, y = (decontaminate._items(df, "item_id", c).select("item_id", F.col("fp").alias(c)) for c in "ab")
    near = x.join(y, "item_id").where(f"bit_count(a ^ b) <= {decontaminate.RADIUS}").count()
    print("within the radius", near / len(pairs))
    assert near / len(pairs) >= 0.99


# ---- 4: near copies


def near_rows(seed=5):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    base, rows = [r.choice(words) for _ in range(120)], []
    for _ in range(90):
        v = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 8])):
            v[r.randrange(len(v))] = r.choice(words)
        rows.append(" ".join(v))
    passage = " ".join(r.choice(words) for _ in range(60))
    rows += [passage + " " + " ".join(r.choice(words) for _ in range(r.choice([3, 8, 15, 30, 80]))) for _ in range(60)]
    rows += [rows[r.randrange(150)] for _ in range(30)]
    return list(enumerate(rows, 1000))


def linked(rows):
    sets, found = {}, {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(A_Z))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for i in ids:
        found[i] = (len(sets[i]), find(i))
    return found


@pytest.mark.parametrize(("short", "often"), [(3, 4), (24, 12)])
def test_ngram_join(spark, monkeypatch, short, often):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    monkeypatch.setattr(ngram_join, "FREQUENT", often)
    rows = near_rows() + [(i, t) for i, t in ODD if i not in (None, 6)]
    random.Random(1).shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs(spark, rows)).collect()}
    assert got == linked(rows)


def test_ngram_join_odd_rows(spark):
    df = docs(spark, ODD)
    assert ngram_join.link_documents(df).count() == len(ODD)
    assert ngram_join.link_documents(empty(spark)).count() == 0
    left = ngram_join.one_of_each_group(df)
    found = [(r.doc_id, r.text) for r in left.collect()]
    ids = [i for i, _ in found]
    # Two texts have the id 6; one of them has a near copy, 11, and a repeated row.
    assert left.columns == df.columns and None in ids and ids.count(6) == 2 and 11 not in ids and 5 not in ids and {1, 2, 3, 4, 12} <= set(ids)
    assert ngram_join.one_of_each_group(empty(spark)).count() == 0


def test_ngram_join_without_ids(spark):
    """A row without an id links two others; rows without ids have a group of their own."""
    words = prose(71, 104).split()
    a, b, c = (" ".join(words[k : k + 90]) for k in (0, 7, 14))
    alone = [(None, prose(72, 50)), (None, prose(72, 50) + " end"), (None, prose(73, 50))]
    rows = [(1, a), (None, b), (2, c), *alone]
    want = linked([(k, t) for k, (_, t) in enumerate(rows)])
    assert want[0][1] == want[1][1] == want[2][1] and want[3][1] == want[4][1] != want[5][1]
    got = collections.Counter((r.doc_id, r.component_id) for r in ngram_join.link_documents(docs(spark, rows)).collect())
    assert got == {(1, 1): 1, (None, 1): 1, (2, 1): 1, (None, None): 3}
    left = collections.Counter((r.doc_id, r.text) for r in ngram_join.one_of_each_group(docs(spark, rows)).collect())
    assert left[1, a] == 1 and sum(left.values()) == 3 and left[None, alone[2][1]] == 1


def test_ngram_join_repeated_rows_are_verified_once(spark, monkeypatch):
    seen, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, sets: seen.append(sets.groupBy("cls").count().where("count > 1").count()) or verified(pairs, sets))
    text = prose(74, 60)
    rows = [(1, text)] * 500 + [(2, text + " more")] * 500 + [(3, prose(75, 60))]
    got = collections.Counter((r.doc_id, r.component_id) for r in ngram_join.link_documents(docs(spark, rows)).collect())
    assert got == {(1, 1): 500, (2, 1): 500, (3, 3): 1} and seen and not any(seen)
    assert sorted(r.doc_id for r in ngram_join.one_of_each_group(docs(spark, rows)).collect()) == [1, 3]


def test_prefixes_keep_what_similar_sets_share():
    r = random.Random(6)
    for _ in range(200):
        n = r.randrange(1, 60)
        a = np.unique(np.array([r.randrange(1 << 62) for _ in range(n)], np.uint64))
        b = a.copy()
        for _ in range(r.randrange(0, 5)):
            b[r.randrange(len(b))] = r.randrange(1 << 62)
        b = np.unique(b)
        pool = np.unique(np.concatenate([a, b]))
        often = pool[[r.random() < 0.6 for _ in pool]] >> np.uint64(24)
        counts = np.array([r.randrange(12, 9000) for _ in often], np.int64)
        (p, m), (q, k) = ngram_join.prefix(a, often, counts), ngram_join.prefix(b, often, counts)
        common = len(np.intersect1d(a, b))
        if 100 * common >= 75 * (len(a) + len(b) - common):
            assert len(np.intersect1d(p, q)) >= min(m, k)


# ---- 5: lines


def line_groups(rows):
    """Components of the lines of rows (id, text), by brute force: line -> root."""
    sets = {}
    for _, t in rows:
        for x in line_dedup.lines_of(t):
            if x:
                sets.setdefault(x, {x[k : k + 8] for k in range(max(1, len(x) - 7))})
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for n, a in enumerate(names):
        for b in names[n + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
                root[find(a)] = find(b)
    return {x: find(x) for x in sets}


@pytest.mark.parametrize("batch", [10_000, 7])
def test_line_dedup(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # lists that go on from batch to batch
    r = random.Random(7)
    base = prose(31, 40)
    edit = lambda x: x[: (p := r.randrange(len(x)))] + "#" + x[p + 1 :]
    lines = [prose(k, 12) for k in range(40)] + [edit(base) for _ in range(30)] + [edit(edit(edit(base))) for _ in range(30)] + ["x", "ab", "ab "]
    rows = [(k, "\n".join(r.choice(lines) for _ in range(6)) + "\n\n") for k in range(60)] + [(i + 100 if i else i, t) for i, t in ODD]
    rows += [(None, rows[3][1]), (200, "twice over\nand over again"), (200, "twice over\nand over again"), (None, "of no id\nbut with lines")]
    group = line_groups(rows)
    got = line_dedup.judge_lines(docs(spark, rows)).collect()
    assert len(got) == sum(bool(x) for _, t in rows for x in line_dedup.lines_of(t))
    texts = {i: t for i, t in rows if i is not None and i < 60}
    of = collections.defaultdict(set)
    for x in got:
        if x.doc_id in texts:
            of[x.component].add(group[line_dedup.lines_of(texts[x.doc_id])[x.no]])
    assert all(len(v) == 1 for v in of.values()) and len({next(iter(v)) for v in of.values()}) == len(of)
    # One line a component stays, repeated rows and null ids or not.
    kept = [x for x in got if x.kept]
    assert len(kept) == len({x.component for x in kept}) == len({x.component for x in got}) == len(set(group.values()))
    least = {}
    for x in got:
        at = (x.doc_id is not None, x.doc_id or 0, x.h, x.row, x.no)
        least[x.component] = min(least.get(x.component, at), at)
    assert {(x.doc_id is not None, x.doc_id or 0, x.h, x.row, x.no) for x in kept} == set(least.values())
    df = docs(spark, rows)
    out = line_dedup.dedup_lines(df)
    left = out.collect()
    assert out.columns == df.columns and len(left) == len(rows)
    assert sum(bool(x) for d in left for x in line_dedup.lines_of(d.text)) == len(kept)
    assert sum(d.text is None for d in left) == sum(t is None for _, t in rows)
    assert sorted(d.text for d in left if d.doc_id == 200) == ["", "twice over\nand over again"]
    assert line_dedup.judge_lines(empty(spark)).count() == 0 and line_dedup.dedup_lines(empty(spark)).count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_line_dedup_parity_maps_lose_no_link():
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghij klmno"))
    for size, changes in ((9, 1), (40, 2), (90, 9), (400, 40), (3000, 300)):
        for _ in range(40):
            x = "".join(rng.choice(letters, size))
            y = list(x)
            for k in rng.integers(0, size, rng.integers(0, changes + 1)):
                y[k] = "z"
            p, q = line_dedup.run_set(x), line_dedup.run_set("".join(y))
            a, b = line_dedup.parity_maps([x, "".join(y)])
            differ = sum(bin(int(u) & (2**64 - 1)).count("1") for u in a ^ b)
            assert differ <= len(np.setxor1d(p, q))
            if size == 40 and 5 * len(np.setxor1d(p, q)) > len(p) + len(q):
                assert 175 * differ > 25 * (len(p) + len(q))  # in short lines nearly every run counts: no pair below 2/3 passes
    assert line_dedup.parity_maps([]).shape == (0, line_dedup.MAP_WORDS)


def test_bands_and_signatures_find_lines_at_the_threshold():
    """Recall of pairs just over 0.75, of lines of 15 to 400 characters: figures of the README."""
    r, met, may, tried = random.Random(11), 0, 0, 0
    while tried < 3000:
        x = "".join(r.choice("abcdefgh ") for _ in range(r.choice([15, 20, 30, 60, 120, 400])))
        y = list(x)
        for _ in range(max(1, round(len(x) / r.choice([45, 50, 60, 70])))):
            y[r.randrange(len(y))] = "#"
        y = "".join(y)
        y = y[r.randrange(1 + len(x) // 8) :] if r.random() < 0.5 else y
        p, q = line_dedup.run_set(x), line_dedup.run_set(y)
        common = len(np.intersect1d(p, q))
        if not 0.75 <= common / (len(p) + len(q) - common) <= 0.8:
            continue
        tried += 1
        a, b = line_dedup.signatures([x, y])
        met += bool((a == b).any())
        bins = [[(int(v) >> 4 * k) & 7 for v in z for k in range(15)] for z in line_dedup.sketches([x, y])]
        equal = sum(u == v for u, v in zip(*bins, strict=True))
        may += bool((a == b).any()) and equal >= line_dedup.least_agreement(np.array([min(len(p), len(q))]))[0]
    print("bands", met / tried, "with signatures", may / tried)
    assert met / tried >= 0.995 and may / tried >= 0.99


# ---- 6: urls


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    listed = universe.where("pmod(hash(key), 7) = 0")
    c = url_filters.build_cascade(listed, universe)
    assert len(c.levels) > 1
    from pyspark.sql import functions as F

    assert universe.where(c.has(F.col("key")) != (F.expr("pmod(hash(key), 7) = 0"))).count() == 0
    assert universe.where(url_filters.build_cascade(listed.limit(0), universe).has(F.col("key"))).count() == 0


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://a.net", "https://net/", "https://example.net/en/1", "https://m.EXAMPLE.net/en/", "https://example.net/en", "https://example.net/de/",
        "http://notexample.com/de/", "http://example.com/de/?a=http://x.net/", "http://x.org/fr/#t", "http://x.org/FR/", "http://org/fr/", "http://a.b.org/fr/y?z", "http://planet/", "http://a.net?x=/", "http://example.com/de/", "http://example.com/de/",
    ]
    pages = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages).collect()}
    for k, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0]
            path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
            host = host.translate(A_Z)
        fits = []
        for rule in (*url_filters.BLOCK, *url_filters.ALLOW):
            h, p = url_filters.split_rule(rule)
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append(rule)
        rule = max(fits, key=len, default=None)
        assert got[k] == (host, path, rule, "block" if rule in url_filters.BLOCK else "allow"), u
    assert url_filters.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filters.judge(pages, (), ()).collect()} == {"allow"}


# ---- 7: quality


def test_quality_classifier(spark):
    r, rows, labels = random.Random(8), [], []
    for k in range(400):
        kind = k % 4
        t = prose(k % 50, 60)
        if kind == 1:
            t = " ".join(w + "***" for w in t.split())
        if kind == 2:
            t = t + " " + " ".join(r.choice(["nastyword", "vilething"]) for _ in range(3))
        rows.append((k, t, "en", f"src{k % 5}"))
        if k < 300:
            labels.append((k, 0 if kind == 1 else 1, 1 if kind == 2 else 0))
    labels += [(None, 1, 1), (3, None, None), (5, 0, 0)]
    df = docs(spark, rows + [(i, t, None, None) for i, t in ODD])
    m = quality_classifier.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = quality_classifier.score(df, m).collect()
    assert len(got) == len(rows) + len(ODD)
    held = [(x.score >= 0.5) == (x.doc_id % 4 in (0, 3)) for x in got if x.doc_id is not None and 300 <= x.doc_id < 400]
    assert sum(held) / len(held) > 0.9
    none = quality_classifier.fit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {round(x.score, 6) for x in quality_classifier.score(df, none).collect()} == {0.5}
    assert quality_classifier.score(empty(spark), m).count() == 0


def test_rare_words_have_weight_at_any_size():
    """Ten rows hold a word that only poor ones have, among 200 or 3,600."""
    for n in (200, 3600):
        y = np.array([k % 2 for k in range(n)], float)
        rows = [np.array([7, 9] if k < 20 and not k % 2 else [9], np.int32) for k in range(n)]
        counts = np.array([np.bincount(np.concatenate([r for r, v in zip(rows, y, strict=True) if v == k]), minlength=16) for k in (0, 1)])
        ratio = quality_classifier.ratios(counts, np.array([n / 2, n / 2]))
        assert ratio[7] < -1 and quality_classifier.fit_content(rows, y, ratio).weights[7] < -1


def test_the_cut_keeps_a_share_of_the_good():
    view = quality_classifier.View(np.linspace(-4, 4, 100).astype(np.float32), 0.0)
    model = quality_classifier.CoTrained(view, quality_classifier.View(np.zeros(1, np.float32), 0.0), 0.0)
    rows, none = [np.array([k]) for k in range(100)], [np.zeros(0, np.int32)] * 100
    found = quality_classifier.cut(model, rows, none, np.ones(100))
    assert (model.score(quality_classifier._flat(rows), quality_classifier._flat(none))[2] >= found).sum() == 95
    assert quality_classifier.cut(model, rows, none, np.zeros(100)) == quality_classifier.KEEP_FROM


def test_views_teach_each_other_over_all_documents(spark):
    """A word that no labelled row has is learned from pages whose source tells their quality, however many they are."""
    rows, labels = [], []
    for k in range(1500):
        bad = k % 2
        text = prose(k % 40, 30) + (" junkword" if bad and k < 300 else "") + (" newterm" if bad and k >= 300 else "")
        rows.append((k, text, "en", "spam.example" if bad else "news.example"))
        if k < 300:
            labels.append((k, 1 - bad, 0))
    df, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    view = quality_classifier.fit(df, lab).content
    slot = quality_classifier._word_bin(b"newterm")
    features = quality_classifier.featured(quality_classifier.labelled(df, lab), "y")
    first = quality_classifier._counts(features, None)
    assert first[0][0][:, slot].sum() == 0 and first[0][1].sum() < 300
    model = quality_classifier.fit(df, lab)
    later = quality_classifier._counts(features, [model.content, model.meta])
    assert later[0][0][0, slot] == 600 and later[0][1].sum() > 1300 and view is not None
    # The counts of one pass are those of a plain loop over the rows.
    bins = [(quality_classifier.content_features(t.encode()), quality_classifier.meta_features(s, g, len(t))) for _, t, g, s in rows]
    p = [quality_classifier._probability(v.odds(*quality_classifier._flat([b[k] for b in bins]))) for k, v in enumerate((model.content, model.meta))]
    known = {r.doc_id: r.y for r in quality_classifier.labelled(df, lab).select("doc_id", "y").collect()}
    for k in range(2):
        want = np.zeros((2, quality_classifier._VIEWS[k][1]), int)
        for i, (b, q) in enumerate(zip(bins, p[1 - k], strict=True)):
            y = known[i] if known[i] is not None else 1 if q >= 0.97 else 0 if q <= 0.03 else -1
            if y in (0, 1):
                want[y, b[k]] += 1
        assert (later[k][0] == want).all()


# ---- 8: shards


def test_sharding(spark):
    rows = ODD + [(20, "same"), (20, "same"), *((30 + k, prose(k, 5 + k)) for k in range(100))]
    got = sharding.place(docs(spark, rows), 5)
    out = got.collect()
    assert len(out) == len(rows) and set(got.columns) == set(docs(spark, rows).columns) | {"slot"}
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append((r.slot, -1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()) + 8))
    last = -2
    for shard in sorted(by):
        by[shard].sort()
        assert [x[0] for x in by[shard]] == list(range(len(by[shard])))
        assert last <= by[shard][0][1] and [x[1] for x in by[shard]] == sorted(x[1] for x in by[shard])
        last = by[shard][-1][1]
    even = sharding.shard_documents(docs(spark, rows[-100:]), 5).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in even]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 2 * max(len(t) + 8 for _, t in rows[-100:])
    assert sharding.place(empty(spark)).count() == 0


def test_shards_equal_a_plain_prefix_sum(spark):
    rows = ODD + [(20, "same")] * 7 + [(30 + k, prose(k, 5 + k)) for k in range(100)]
    order = sorted((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    whole, at, want, slots = sum(o[3] for o in order), 0, collections.Counter(), collections.Counter()
    for known, i, crc, size in order:
        at += size
        shard = (2 * at - size) * 5 // (2 * whole)
        want[i if known else None, size, crc, shard, slots[shard]] += 1
        slots[shard] += 1
    got = collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(docs(spark, rows), 5).collect())
    assert got == want
    placed = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in sharding.place(docs(spark, rows), 5).collect())
    assert placed == want


@pytest.mark.parametrize("whole,last", [(30_000_000_000, 8), (30_000_000_000, 1000), (500_000_000, 12), (8, 8)])
def test_the_last_row_stays_in_the_last_shard(spark, whole, last):
    cuts = [-(-whole * k // 24) for k in range(1, 24)]
    ends = sorted({e for c in [*cuts, whole] for e in (c - 1, c, c + 1, c + last) if last <= e <= whole})
    df = spark.createDataFrame([(e, last) for e in ends], "e long, s long")
    got = {r.e: r.shard for r in df.select("e", sharding.shard_of("e", "s", whole, 24).alias("shard")).collect()}
    assert got == {e: (2 * e - last) * 24 // (2 * whole) for e in ends} and got[whole] <= 23


# ---- 9: rules


def test_quality_rules(spark):
    rows = [*ODD, (50, prose(9, 30)), (51, "a b c d e f g h " * 30), (52, " ".join(w + "###" for w in prose(9, 30).split())), (53, prose(9, 40).upper()), (54, "l i\n" * 9 + prose(1, 40))]
    df = docs(spark, rows)
    got = quality_rules.Cascade.fit(df).judge(df).collect()
    assert len(got) == len(rows)
    texts = collections.defaultdict(list)
    for i, t in rows:
        w = WORD.findall(t or "")
        wins = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {p for k in range(len(w) - 7) if wins[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        base = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        texts[i].append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), base))
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in texts[r.doc_id]
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert 50 in kept and not kept & {51, 52, 53}
    orders = [quality_rules.Cascade(tuple(reversed(quality_rules.RULES))), quality_rules.Cascade(quality_rules.RULES)]
    assert len({tuple(sorted(str(r.doc_id) + str(r.kept) for r in c.judge(df).collect())) for c in orders}) == 1
    left = orders[0].filter(df)
    assert left.columns == df.columns and left.count() == sum(r.kept for r in got)
    assert quality_rules.Cascade.fit(empty(spark)).judge(empty(spark)).count() == 0


# ---- 10: mixing


def test_mixing(spark):
    rows, labels = list(ODD), []
    for k in range(300):
        t = prose(k % 40, 50)
        if k % 3 == 1:
            t = " ".join(w + "***" for w in t.split())
        if k % 10 == 2:
            t += " nastyword vilething"
        rows.append((1000 + k, t))
        labels.append((1000 + k, 0 if k % 3 == 1 else 1, 1 if k % 10 == 2 else 0))
    df, lab = docs(spark, rows), spark.createDataFrame(labels + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix(df, lab).collect()
    assert len(out) == len(rows)
    totals = [sum(r.rate * r.tokens * r.p[k] for r in out) for k in range(3)]
    want = [mixing.TARGETS[d] for d in mixing.DOMAINS]
    assert all(abs(t / sum(totals) - w) < 0.01 for t, w in zip(totals, want, strict=True))
    assert all(math.isclose(sum(r.p), 1) for r in out)
    assert [r.tokens for r in sorted(out, key=lambda r: (r.doc_id or -1, r.tokens))] == [n for _, n in sorted((i or -1, len(WORD.findall(t or ""))) for i, t in rows)]
    mixed = mixing.mixed_documents(df, lab)
    assert mixed.columns == df.columns and {r.doc_id for r in mixed.select("doc_id").distinct().collect()} == {i for i, _ in rows}
    assert mixing.mix(df, lab.limit(0)).count() == len(rows)
    assert mixing.mix(empty(spark), lab).count() == 0 and mixing.mixed_documents(empty(spark), lab.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_rates_equal_those_of_a_plain_solver(spark, least):
    """The same descent in numpy."""
    r = np.random.default_rng(3)
    tokens, p = r.integers(0, 400, 200), r.dirichlet([2, 1, 0.7], 200)
    df = spark.createDataFrame([(k, int(t), x.tolist()) for k, (t, x) in enumerate(zip(tokens, p, strict=True))], "k long, tokens long, p array<double>")
    rates, want = mixing.fit_rates(df, least=least)
    got = np.array([x.rate for x in rates.orderBy("k").collect()])
    mass, want = tokens[:, None] * p, np.array(want)
    assert got.min() >= least
    gram = mass.T @ mass
    plain, free, gaps = np.ones(200), np.ones(200, bool), []
    while len(gaps) < 60:
        left = want - plain @ mass
        gaps.append(np.abs(left).max() / want.sum())
        if gaps[-1] <= mixing.CLOSE:
            break
        raw = plain + mass @ np.linalg.solve(mass[free].T @ mass[free] + 1e-3 * gram, left)
        plain, free = np.maximum(least, raw), raw > least
    gap = np.abs(want - got @ mass).max() / want.sum()
    assert gap <= 1.5 * min(gaps) + 2e-5 or least == 1.0 and gap < 0.02
    if least == 0.0:
        assert gap < 2e-5 and np.allclose(got, plain, atol=1e-4)


def test_targets_out_of_reach_are_told(spark):
    df = spark.createDataFrame([(0, 10, [1.0, 0.0, 0.0]), (1, 10, [0.0, 1.0, 0.0]), (2, 10, [0.0, 0.0, 1.0])], "k long, tokens long, p array<double>")
    with pytest.warns(UserWarning, match="were asked for"):
        mixing.fit_rates(df, steps=0)


@pytest.mark.parametrize("most", [500_000, 0])
def test_mixing_knows_the_words_of_rare_languages(spark, monkeypatch, most):
    """Many telling words of one language do not push out the few of another, broadcast or not."""
    monkeypatch.setattr(mixing, "BROADCAST_FEATURES", most)
    rows, labels = list(ODD), []
    for k in range(800):
        t, toxic = prose(k % 40, 30), k % 4 == 0
        if toxic:
            t += " lumpenwort schmutzwort" if k % 80 == 0 else " " + " ".join("insult" + chr(97 + (k + j) % 26) + chr(97 + (k // 4 + j) % 4) for j in range(26))
        rows.append((1000 + k, t))
        labels.append((1000 + k, 1, int(toxic)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    priors, features = mixing.fit_classifier(docs(spark, rows), lab)
    assert features.count() > 64 and {r.f for r in features.collect()} >= {"lumpenwort", "schmutzwort"}
    out = {r.doc_id: r.p for r in mixing.mix(docs(spark, rows), lab).collect() if r.doc_id is not None}
    assert all(out[1000 + k][2] > 0.5 for k in range(0, 800, 80))
    assert sum(out[1000 + k][2] > 0.5 for k in range(800) if k % 4) == 0


# ---- columns of any name, entries, the pipeline


def test_columns_of_the_operators_own_helpers_do_not_clash(spark):
    names = ["_gone", "_row", "_host", "_path", "_keys", "_block", "_allow", "__copies", "__copy", "__n", "__k", "__id", "__h", "__th", "__leak", "_h", "_th", "_i"]
    df = docs(spark, [(k, prose(k, 40)) for k in range(8)] + [(None, None), (3, prose(3, 40))])
    for c in names:
        df = df.withColumn(c, F.lit(7))
    lab = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(5, 40))], "item_id long, text string")
    found = {
        "lines": line_dedup.dedup_lines(df), "copies": ngram_join.one_of_each_group(df), "leaks": decontaminate.clean_documents(df, bench), "rules": quality_rules.Cascade.fit(df).filter(df),
        "mixed": mixing.mixed_documents(df, lab),
    }
    for name, out in found.items():
        assert out.columns == df.columns and all(r._gone == 7 and r["__n"] == 7 for r in out.collect()), name
    assert set(sharding.place(df).columns) == {*df.columns, "slot"} and sharding.place(df).count() == 10
    urls = df.withColumn("url", F.lit("https://a.net/x"))
    out = url_filters.judge(urls).collect()
    assert len(out) == 10 and all(r._host == 7 and r._keys == 7 and r.verdict == "block" for r in out)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The tables of a very small corpus, odd rows included."""
    at = str(tmp_path_factory.mktemp("sf"))
    base = [(k, prose(k, 60), "en", f"src{k % 3}") for k in range(60)]
    base += [(100 + k, prose(k, 60) + " end", "en", "src0") for k in range(10)] + [(200, prose(900, 30) + " " + prose(901, 40) + " " + prose(902, 30), "de", "src1"), (201, "#### " * 40, "de", None)]
    write = lambda df, name: df.coalesce(1).write.parquet(f"{at}/{name}.parquet")
    write(docs(spark, base + [(i, t, None, None) for i, t in ODD]).select("doc_id", "text", "lang", "source", "n_chars"), "documents")
    write(spark.createDataFrame([(k, int(k % 4 > 0), int(k % 7 == 0)) for k in range(40)], "doc_id long, quality int, toxic int"), "labels")
    write(spark.createDataFrame([(1, prose(901, 40)), (2, None)], "item_id long, text string"), "benchmark")
    write(spark.createDataFrame([(1, "https://a.net/x", "<p>" + prose(1, 40)), (2, None, None)], "page_id long, url string, html string"), "pages")
    return at


@pytest.mark.parametrize("name", sorted(llm_queries.queries()))
def test_entries_have_a_row_each(spark, sf_dir, name):
    out = llm_queries.queries()[name](spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = {"op2_language_id": n + 2, "op6_url_filters": 2}.get(name, n)
    assert out.count() == rows if name != "op3_decontaminate" else {r.doc_id for r in out.collect()} == {200}


def test_pipeline(spark, sf_dir, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    kept = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [kept.count()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, kept, sf_dir).write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        assert kept.columns == (columns if k < 4 else [*columns, "shard", "slot"])
        sizes.append(kept.count())
    ids = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/1").collect()]
    # Rules: no short, empty or shouting text. Copies: the least id of each group. Leaks: 200 goes. The mixture loses no document.
    assert not {1, 2, 3, 4, 8, 12, 201} & {r.doc_id for r in spark.read.parquet(f"{tmp_path}/0").where("text is null or length(text) < 30").collect()}
    assert set(range(20, 60)) <= set(ids) and not {100, 105, 109} & set(ids)
    final = kept.collect()
    assert 200 in ids and 200 not in {r.doc_id for r in final} and {i for i in ids if i != 200} == {r.doc_id for r in final}
    by = collections.defaultdict(list)
    for r in final:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(by) < 24 and sizes[3] <= sizes[2] <= sizes[1] < sizes[0]
    again = pipeline.run(spark, sf_dir).collect()
    assert sorted(map(str, again)) == sorted(map(str, final))


def test_pipeline_of_nothing(spark, sf_dir, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


# ---- SQL twins of 4 and 8


def test_sql_twins_of_join_and_shards(spark):
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(5)
    words = [" ".join(r.choice(["Aa", "b", "ccc", "dé", "€"]) + str(r.randrange(40)) for _ in range(30)) for _ in range(6)]
    texts = [*words, *[x + " end" for x in words], words[0], "two words", "two words", "", None, "\t ", "long " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    documents = docs.toArrow()  # noqa: F841 (the SQL reads it)
    for sql, found in ((ngram_join.OP4_SQL, ngram_join.link_documents(docs)), (sharding.OP8_SQL, sharding.shard_documents(docs))):
        names = [c for c in ("doc_id", "n_shingles", "component_id", "size", "text_crc32", "shard", "slot") if c in found.columns]
        want = con.sql(sql).select(*names).fetchall()
        assert sorted(want) == sorted(tuple(x) for x in found.select(*names).collect())


def test_texts_are_moved_once_to_their_shards(spark):
    rows = [(k % 7 if k % 5 else None, f"text {k % 3}") for k in range(60)] + [(3, None)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        placed = sharding.place(df, 4)
        plan = placed._jdf.queryExecution().executedPlan().toString()
        got = placed.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("LogicalRDD") + plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1
    want = collections.Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(df, 4).collect())
    assert collections.Counter((r.doc_id, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in got) == want
