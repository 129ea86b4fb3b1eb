"""Decontamination, packing, Jaccard join and suffix dedup against brute force, and the pipeline stage by stage."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanward.llm import decontam, jaccard, packing, queries, suffix
from spanward.session import CLEAN_UP, materialise

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHINGLED = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def docs_of(spark, rows, parts=4):
    """Documents with extra columns whose names operators use themselves."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(parts)
    return df.selectExpr("doc_id", "text", "'x' AS doc_key", "'y' AS fp", "1 AS n", "2 AS segment", "3 AS part", "'z' AS source")


# -- decontamination -----------------------------------------------------------------------


def brute_hits(docs, items, width=10):
    windows, sizes = collections.defaultdict(set), set()
    for i, text in items:
        words = WORD.findall(low(text))
        n = min(width, len(words))
        if i is not None:
            for at in range(len(words) - n + 1 if n else 0):
                windows[tuple(words[at : at + n])].add(str(i))
                sizes.add(n)
    out = []
    for d, text in docs:
        words, hit, found = WORD.findall(low(text)), set(), set()
        for n in sizes:
            for at in range(len(words) - n + 1):
                if items_here := windows.get(tuple(words[at : at + n])):
                    hit.update(range(at, at + n))
                    found |= items_here
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def passages():
    random.seed(6)
    vocab = [f"w{i}" for i in range(30)] + ["É", "ß", "X9"]
    say = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    items = [(i, say(random.choice([1, 2, 5, 9, 10, 11, 30]))) for i in range(2, 14)] + [(20, None), (21, "..."), (None, say(12)), (2, say(15)), (22, "alpha")]
    docs = []
    for i in range(60):
        text = say(random.randint(0, 60))
        if i % 3 == 0:
            words = (random.choice(items)[1] or "").split()
            text += "; " + " ".join(words[random.randint(0, 3) : len(words) - random.randint(0, 2)]).upper() + "! " + say(8)
        docs.append((i, text))
    return docs + [(70, None), (71, ""), (72, "..."), (None, items[3][1]), (73, items[4][1]), (73, items[4][1]), (74, "pad " * 20_000 + "alpha")], items


def test_decontamination_equals_brute_force(spark, monkeypatch):
    docs, items = passages()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 AS size", "2 AS terms")
    want = brute_hits(docs, items)
    assert sum(r[5] for r in want) > 15
    for chunk in (150_000, 40):  # one pass, and several that are put together
        monkeypatch.setattr(decontam, "CHUNK_WINDOWS", chunk)
        got = sorted([tuple(r) for r in decontam.decontaminate(docs_of(spark, docs), bench).collect()], key=str)
        assert got == want
    none = decontam.decontaminate(docs_of(spark, docs), bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert decontam.decontaminate(docs_of(spark, docs).limit(0), bench).count() == 0


def test_near_matches(spark):
    docs = [(1, "a x b y c"), (2, "c b a"), (3, "a b " + "z " * 9 + "c"), (4, "a b")]
    index = decontam.build_index(docs_of(spark, docs))
    windows = decontam.windows_of(spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    near = decontam.find_windows(index, windows, near=5).where(F.size("items") > 0)
    assert sorted(r.doc_id for r in near.collect()) == [1, 2]
    assert decontam.find_windows(index, windows).where(F.size("items") > 0).count() == 0


def test_decontamination_of_the_tables(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted([tuple(r) for r in queries.QUERIES["op3_decontamination"](spark, data).collect()], key=str)
    assert got == brute_hits(docs, items)


# -- packing -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.tokenizer_file())


def test_word_ids_equal_the_tokenizer(tokenizer):
    coder = packing.WordIds(queries.tokenizer_file())
    random.seed(3)
    parts = ["a", "B", "é", "É", "'s", "'", "'ll", " ", "\n", "\t", ",", ".", "<", "|", ">", "<|endoftext|>", "<|ENDOFTEXT|>", "5", "12", "×", "œ", "…",
             "́", "̸", "̇", "=", "漢", "İ", "I", "Ⅷ", "²", "  ", "#", "%%%", "😀", "\x1c", "\x0b", "ß", "ª", "_", "K", "n't", "\xa0"]
    for _ in range(500):
        texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(4)]
        ids, first = coder.encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert list(ids[first[i] : first[i + 1]]) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_cuts():
    for n in range(1, 13_000, 7):
        pieces = packing.cut_lengths(n)
        assert sum(pieces) == n and all(0 < p <= 4096 for p in pieces)
        assert all(packing.CAPACITY // (packing.CAPACITY // p) == p for p in pieces if p > packing.SMALL)


def test_packing_keeps_every_id_once(spark, tokenizer):
    random.seed(8)
    docs = [(i, " ".join(random.choice(["der", "thing", "Éa%%%", "x1"]) for _ in range(random.choice([0, 1, 30, 400, 3000, 9000])))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "null id"), (102, "same"), (102, "same")]
    rows = packing.harmonic_pack(docs_of(spark, docs), queries.tokenizer_file(), keep_ids=True).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.length * 4 == len(r.ids) and zlib.crc32(r.ids) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, text in docs:
        own = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        mine = sorted(pieces[doc])
        if doc == 102:
            assert [m[1] for m in mine] == [own, own]
        else:
            assert b"".join(m[1] for m in mine) == own and all(m[2] * 4 == len(own) for m in mine)
    padding = used = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        used += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.04 * used
    assert packing.harmonic_pack(docs_of(spark, docs).limit(0), queries.tokenizer_file()).count() == 0


# -- n-gram Jaccard join -------------------------------------------------------------------


def shingles(text, width):
    words = SHINGLED.findall(low(text))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_components(docs, width, num, den):
    sets = [(d, shingles(text, width)) for d, text in docs]
    distinct = sorted({s for _, s in sets if s}, key=len)
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(distinct):
        for j in range(i + 1, len(distinct)):
            b = distinct[j]
            if len(a) * den < num * len(b):
                break
            common = len(a & b)
            if den * common >= num * (len(a) + len(b) - common):
                parent[root(i)] = root(j)
    place = {s: root(i) for i, s in enumerate(distinct)}
    least = {}
    for d, s in sets:
        if s and d is not None:
            least[place[s]] = min(least.get(place[s], d), d)
    return sorted(((d, len(s), least.get(place[s]) if s else d) for d, s in sets), key=str)


def near_copies(seed):
    """Groups of variants of variants: some are linked to a base, others only to each other."""
    random.seed(seed)
    vocab, few, docs = [f"w{i}" for i in range(400)], [f"v{i}" for i in range(8)], []
    for _ in range(5):
        n = random.choice([12, 40, 60, 100])
        base = [random.choice(vocab) for _ in range(n)]
        for _ in range(10):
            variant = list(base)
            for _ in range(random.choice([0, 1, 2, 4, 6, 8])):
                variant[random.randrange(n)] = random.choice(few)
            for _ in range(random.choice([1, 4])):
                text = list(variant)
                for _ in range(random.choice([0, 1, 1, 2])):
                    text[random.randrange(n)] = random.choice(few)
                docs.append((1000 - len(docs), " ".join(text if random.random() < 0.8 else text[: -random.randint(1, 3)])))
    random.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "width", "num"), [(11, 3, 90), (12, 2, 80)])
def test_links_equal_brute_force(spark, seed, width, num):
    docs = near_copies(seed) + [(1, None), (2, ""), (3, " \t"), (4, "a"), (5, "A"), (5, "A"), (None, "a"), (6, "a b"), (7, "rep " * 4000), (None, "alone here")]
    want = brute_components(docs, width, num, 100)
    got = jaccard.link_components(docs_of(spark, docs), width, num, 100).select("doc_id", "n_shingles", "component_id")
    assert sorted([tuple(r) for r in got.collect()], key=str) == want
    assert len({c for _, _, c in want}) < len(docs) - 20


def test_links_of_nested_texts_equal_brute_force(spark):
    """Two texts that fit by their sizes can meet only in a star round a third one that does not fit one of them."""
    rng, docs = random.Random(5), []
    for family in range(400):
        words = [f"w{rng.randrange(10**9)}" for _ in range(42)]
        n = 10 + family % 31
        docs += [(10 * family + i, " ".join(words[: n + i])) for i in range(3)]
    for width, num in ((3, 90), (5, 80)):
        got = jaccard.link_components(docs_of(spark, docs), width, num, 100).select("doc_id", "n_shingles", "component_id")
        assert sorted([tuple(r) for r in got.collect()], key=str) == brute_components(docs, width, num, 100)


def test_counts_of_own_shingles_make_no_row_per_class_and_bucket(spark):
    rng = np.random.default_rng(8)
    common = rng.integers(0, 1 << 62, 30).tolist()
    sets = {fp: set(rng.integers(0, 1 << 62, 20 + i % 7).tolist()) | set(common[: i % 11]) for i, fp in enumerate(rng.integers(-(1 << 62), 1 << 62, 300).tolist())}
    count = collections.Counter(e for s in sets.values() for e in s)
    want = {}
    for fp, s in sets.items():
        n, alone = len(s), sum(count[e] == 1 for e in s)
        want[fp] = (n, (n * 80 + 99) // 100, min(n * 100 // 80, (n - alone) * 180 // 80 - n))
    rows = spark.createDataFrame([(fp, sorted(s)) for fp, s in sets.items()], "fp long, shingles array<long>")
    assert {r.fp: (r.n, r.low, r.high) for r in jaccard._reach(rows, 80, 100).collect()} == want
    owners, keys = zip(*[(fp, e) for fp, s in sets.items() for e in s if count[e] == 1])
    bucket = pa.table({"pairs": [False], "x": [np.array(keys, np.uint64).tobytes()], "y": [np.array(owners, np.int64).tobytes()]})
    assert jaccard._alone(4)(bucket).num_rows <= 4


def test_a_long_centre_is_not_repeated_for_every_class(spark, monkeypatch):
    """Tables of differences hold no more than the sets, and what they propose has all similar pairs."""
    rng = np.random.default_rng(7)
    core = rng.integers(0, 1 << 62, 3000)
    sets = {0: set(core.tolist())}
    for family in range(15):
        base = rng.integers(0, 1 << 62, 40).tolist() + core[family : family + 5].tolist()
        for i in range(4):
            sets[10 + 4 * family + i] = set(base) - set(base[3 * i : 3 * i + 1 + i % 2]) | set(rng.integers(0, 1 << 62, i % 3).tolist())
    fps = sorted(sets)
    rows = [(fp, len(sets[fp]), -(-len(sets[fp]) * 80 // 100), len(sets[fp]) * 100 // 80) for fp in fps]
    written = {}

    def kept(df, name):
        written[name] = materialise(df, name)
        return written[name]

    monkeypatch.setattr(jaccard, "materialise", kept)
    got = jaccard._past_failures(
        spark.createDataFrame([(0, fp, 1) for fp in fps[1:]], "a long, b long, n long"), spark.createDataFrame([], "node long, label long"),
        spark.createDataFrame(rows, "fp long, n long, low long, high long"), spark.createDataFrame([(fp, sorted(sets[fp])) for fp in fps], "fp long, shingles array<long>"), 80, 100,
    )
    similar = {(a, b) for a in fps for b in fps if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(similar) > 20 and similar <= {tuple(r) for r in got.select("a", "b").collect()}
    arrays = [c for c, kind in written["changes"].dtypes if kind == "array<bigint>"]
    assert arrays and sum(len(r[c]) for r in written["changes"].collect() for c in arrays) <= sum(map(len, sets.values()))


def test_signatures_of_few_classes_chain_no_group(spark, monkeypatch):
    """Each text shares half its words with the next one: proposals chain them all, but hide no pair."""
    rng, written = random.Random(6), {}
    blocks = [[f"w{rng.randrange(10**9)}" for _ in range(20)] for _ in range(301)]
    docs = [(i, " ".join(a + b)) for i, (a, b) in enumerate(zip(blocks, blocks[1:]))] + [(1000, " ".join(blocks[0] + blocks[1][:-1]))]

    def kept(df, name):
        written[name] = materialise(df, name)
        return written[name]

    monkeypatch.setattr(jaccard, "materialise", kept)
    got = jaccard.link_components(docs_of(spark, docs), 5, 80, 100).select("doc_id", "n_shingles", "component_id")
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_components(docs, 5, 80, 100)
    assert written["proposed"].count() > 30 and written["changes"].count() == 0


def test_a_signature_of_few_classes_proposes_all_pairs_and_one_of_many_a_star(spark):
    few, many, apart = 1, 2, 3  # signatures; the last one has its classes in two tasks
    n = jaccard.SHARED

    def row(key, owners):
        return False, np.full(len(owners), key, np.uint64).tobytes(), np.array(owners, np.int64).tobytes()

    rows = [row(few, range(n)), row(many, range(100, 101 + n)), row(many, [100]), row(apart, range(200, 200 + n)), row(apart, [190])]
    rows.append((True, np.array([100], np.int64).tobytes(), np.array([999], np.int64).tobytes()))
    met = jaccard._meet(pa.table({c: pa.array(list(v)) for c, v in zip(("pairs", "x", "y"), zip(*rows))})).to_pylist()
    want = {(a, b, 1, False) for a in range(n) for b in range(a + 1, n)} | {(100, b, 1, True) for b in [*range(101, 101 + n), 999]}
    want |= {(190, b, 1, True) for b in range(200, 200 + n)}
    assert sorted(tuple(r.values()) for r in met) == sorted(want)


def test_what_was_shuffled_for_a_written_table_goes_at_once(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {b for b in re.findall(r"shuffle_\d+", blocks.getAllBlocks().mkString(" "))}

    before, setting = shuffles(), spark.conf.get(CLEAN_UP, "false")
    kept = materialise(spark.range(5000).selectExpr("id % 977 AS k").groupBy("k").count(), "counts")
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    else:
        raise AssertionError(shuffles() - before)
    assert kept.count() == 977
    assert spark.conf.get(CLEAN_UP, "false") == setting


def test_links_of_the_tables(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op7_ngram_jaccard_join"](spark, data)
    assert sorted([tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()], key=str) == brute_components(docs, 3, 90, 100)
    assert jaccard.link_components(docs_of(spark, [(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("num, share", [(90, 10), (80, 5), (60, 3)])
def test_signatures_miss_no_similar_sets(num, share):
    rng = np.random.default_rng(1)
    make, met = jaccard.Signatures(num, 100), 0
    for size in [5, 8, 9, 10, 11, 14, 19, 20, 25, 38, 39, 60, 148, 500, 1999]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            gone, new = rng.integers(0, size // share + 1), rng.integers(0, size // share + 1)
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 64, new, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= num * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                met += 1
                assert np.intersect1d(make.of(a), make.of(b)).size, (size, gone, new)
    assert met > 100


def test_sets_that_share_nothing_share_no_signature():
    rng = np.random.default_rng(2)
    make = jaccard.Signatures(80, 100)
    own = [make.of(np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))) for size in rng.integers(100, 400, 300)]
    keys, n = np.unique(np.concatenate(own), return_counts=True)
    assert (n > 1).sum() < 30  # a few sets have so many empty cells that they sign empty choices


# -- suffix-array dedup --------------------------------------------------------------------


def brute_repeats(docs, length):
    count, bodies = collections.Counter(), [(d, (t or "").encode()) for d, t in docs]
    for _, b in bodies:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] += 1
    out = []
    for d, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def shared_texts(seed, n=120):
    random.seed(seed)
    noise = lambda k: "".join(random.choice("abcdé ") for _ in range(k))
    pool = [noise(random.choice([150, 199, 200, 201, 260, 400, 900])) for _ in range(12)]
    docs = []
    for i in range(n):
        text = ""
        for _ in range(random.randint(0, 4)):
            p = random.choice(pool)
            text += p[random.randint(0, 40) : len(p) - random.randint(0, 40)] if random.random() < 0.6 else noise(random.randint(0, 300))
        docs.append((i, text))
    return docs + [(900, None), (901, ""), (902, "a" * 500), (903, "ab" * 300), (904, "x" * 200), (905, "x" * 200), (5, "dup" * 80), (5, "dup" * 80), (None, "q" * 199)]


@pytest.mark.parametrize("seed", [2, 3])
def test_repeats_equal_brute_force(spark, seed):
    docs = shared_texts(seed)
    got = suffix.repeat_digests(docs_of(spark, docs))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_repeats(docs, 200)
    assert suffix.repeat_digests(docs_of(spark, docs).limit(0)).count() == 0


def test_repeats_of_many_small_flushes():
    """What a task combines and what buckets combine give the same flags."""
    rng = np.random.default_rng(5)
    docs = [bytes(rng.integers(97, 100, 300, dtype=np.uint8)) + b"z" * 230 + bytes(rng.integers(97, 100, 40, dtype=np.uint8)) for _ in range(6)]
    column = pa.array([d.decode() for d in docs])
    data, offsets = suffix.flat(column)
    _, place, first, last = suffix.anchors(data, offsets, 200, 48)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    want = np.concatenate([np.arange(offsets[i], offsets[i + 1] - 199) for i in range(len(docs))])
    assert sorted(starts) == sorted(want)  # every start of a string belongs to one anchor
    inside = np.repeat(place, last - first + 1)
    assert ((inside >= starts) & (inside + 48 <= starts + 200)).all()


def test_repeats_of_the_tables(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op10_suffix_array_dedup"](spark, data)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_repeats(docs, 200)


def test_removal_keeps_whole_characters(spark):
    passage = "éß" * 70  # 280 bytes; a window may begin inside a character
    docs = docs_of(spark, [(1, "x" + passage + "y"), (2, passage), (3, "clean text"), (4, None)])
    out = {r.doc_id: r for r in suffix.remove_repeats(docs).collect()}
    assert out[3].text == "clean text" and out[4].text is None and out[1].text == "xy" and out[2].text == ""
    assert suffix.remove_repeats(docs).columns == docs.columns


# -- pipeline ------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns and docs.count() > 0
        rows = {r.doc_id: r for r in before.collect()}
        if name == "ngram_jaccard_join":
            linked = brute_components([(i, r.text) for i, r in rows.items()], 5, 80, 100)
            assert {r.doc_id for r in docs.collect()} == {d for d, _, c in linked if d == c}
        elif name == "suffix_array_dedup":
            after = {r.doc_id: r for r in docs.collect()}
            for d, n_bytes, removed, _, _ in brute_repeats([(i, r.text) for i, r in rows.items()], 200):
                assert (len(after[d].text.encode()) == n_bytes) == (removed == 0) and after[d].n_chars == len(after[d].text)
        elif name == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
            hits = brute_hits([(i, r.text) for i, r in rows.items()], items)
            assert {r.doc_id for r in docs.collect()} == {h[0] for h in hits if not h[5]}
        elif name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(rows)
    assert seen == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "packing"]


def test_pipeline_of_odd_rows(spark, data, tmp_path):
    """Nulls, repeated rows and extra columns go through every stage."""
    rows = [(1, None), (2, ""), (3, "some words of a text"), (3, "some words of a text"), (4, "some words of a text"), (None, "a text without an id")]
    docs = docs_of(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert sorted({r.doc_id for r in docs.collect()}, key=str) == [1, 2, 3, None]
