"""Training-data operators against brute force, round trips, and hard inputs (nulls, empty, long, ties, repeated rows)."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelake.llm import decontaminate, hashing, html_text, huffman, jaccard_join, language_id, packing, quality, warc
from allelake.llm.compaction import CommitConflict, ShardStore, compacted
from allelake.llm.components import connected_components
from allelake.llm.hnsw import nearest
from allelake.llm.queries import tokenizer_file
from allelake.llm.tokens import Encoder

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, key string, n long, label int"
LONG = " ".join(f"w{i}" for i in range(30_000))


def docs_of(spark, rows):
    """Documents with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "en", "s", "k", 1, 0) for i, t in rows], DOCS)


def table(spark, name):
    return spark.read.parquet(f"{D}/{name}.parquet")


HARD = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "one"), (None, "no id here at all"), (7, LONG), (8, LONG), (9, "Ünï çödé 日本 text"), (9, "other text with the same id"), (10, "...!!! 123")]


# --- Jaccard join


def word_sets(rows, k):
    out = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    return out


def brute_components(rows, k, percent):
    s, parent = word_sets(rows, k), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][0], rows[j][0]
            common = len(s[i] & s[j])
            if a is not None and b is not None and s[i] and 100 * common >= percent * len(s[i] | s[j]) and common:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(x), None if d is None else find(d)) for (d, _), x in zip(rows, s, strict=True)), key=str)


def joined(spark, rows, k, percent):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs_of(spark, rows), k, percent).collect()), key=str)


def test_jaccard_hard_inputs(spark):
    assert joined(spark, HARD, 4, 85) == brute_components(HARD, 4, 85)
    assert joined(spark, [], 4, 85) == []


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_brute_force(spark, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "MORE_CANDIDATES", 2)  # several rounds
    rng = np.random.default_rng(k)
    words = [f"w{i}" for i in range(300)]
    passage = list(rng.choice(words, 40))
    rows = []
    for base in range(12):
        text = list(rng.choice(words, int(rng.integers(3, 90)))) + passage * (base % 3 == 0)
        for copy in range(int(rng.integers(1, 9))):
            t = list(text)
            for _ in range(int(rng.integers(0, 1 + len(t) // 25))):
                t[int(rng.integers(len(t)))] = str(rng.choice(words))
            rows.append((len(rows) * 7 % 1009, " ".join(t)))
    assert joined(spark, rows, k, percent) == brute_components(rows, k, percent)


def test_sketches_bound_the_difference():
    """Linked sets differ in no more segments than the bound, so one at least is equal, and in no more bits."""
    rng = np.random.default_rng(0)
    lows = jaccard_join.bands(5000)
    differ, parts, _ = jaccard_join.segments(lows, 85)
    assert (parts > differ).all()
    for n in (1, 5, 6, 7, 40, 1000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        gone = n * 15 // 100
        b = a[gone:]
        band = np.searchsorted(lows, len(b), "right") - 1
        assert gone <= differ[band]
    sk = lambda x, m: np.packbits((np.bincount((hashing.mix(x, 23) & np.uint64(m - 1)).astype(int), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    b = np.concatenate([a[30:], rng.integers(0, 2**63, 20).astype(np.uint64)])
    assert jaccard_join._differing_bits(sk(a, 1024), sk(b, 1024)) <= 50
    assert jaccard_join._differing_bits(sk(a, 2048), sk(b, 1024)) <= 50  # folded


def test_components(spark, tmp_path):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/c").collect()
    assert {(r.node, r.component) for r in got} == {(x, find(x)) for a, b in edges for x in (a, b) if a != b}
    assert connected_components(spark.createDataFrame([], "a long, b long"), f"file://{tmp_path}/e").count() == 0


# --- Tokens, Huffman, packing

ODD = ["", " ", "\n\n  x", "it's 'salut we'll they've  I'M o'reilly''s 's  'd", " 's\n's\t't x  \n", "''s", "x\x1cy z  w", "日本 hello's", "éa ﬁ İx ΣΑΣ", "123 45a6 ½²", "<|endoftext|> hi", "a’s — x …", "\r\n\r\n a", "don't\nDON'T", "a\u0000b", "_a_b", "éa", LONG[:5000]]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(spark, name):
    e = Encoder(tokenizer_file(name))
    texts = ODD + [r.text for r in table(spark, "documents").limit(60).collect()]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    ids, bounds = e.encode(raw, off)
    expected = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == expected


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_in_texts(spark, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    texts = ["a <|endoftext|> hi", "", "plain", "<|endoftext|><|startoftext|>", "<|endof", "text|>", "日本 <|endoftext|>", "<|ENDOFTEXT|>", *ODD]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])])
    ids, bounds = Encoder(tokenizer_file(name)).encode(raw, off)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert t.token_to_id("<|endoftext|>") in ids.tolist()
    own = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    out = huffman.token_round_trip(docs_of(spark, list(enumerate(texts))), tokenizer_file(name), end_id=2).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in out] == [(len(x), crc(x)) for x in own]


def all_ids(rows, name, end):
    t = Encoder(tokenizer_file(name)).tokenizer
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for _, x in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_huffman_codes():
    rng = np.random.default_rng(2)
    for counts in ([], [5], [3, 0, 4], list(rng.integers(1, 1000, 200)), [1 << i for i in range(30)]):
        counts = np.array(counts, np.int64)
        for most in (8, 12, 20):
            n = huffman.code_lengths(counts, most)
            assert n.max(initial=0) <= most and ((n > 0) == (counts > 0)).all()
            if (counts > 0).sum() > 1:
                assert sum(2.0 ** -float(x) for x in n if x) == 1
    # Without a limit that binds, the total is Huffman's.
    import heapq

    counts = rng.integers(1, 500, 60)
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    assert (counts * huffman.code_lengths(counts, 20)).sum() == total


def test_huffman_blocks():
    rng = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = np.minimum(rng.geometric(0.05, n), 90)
        lengths = huffman.code_lengths(np.bincount(np.append(ids, [1, 2]), minlength=100))
        data = huffman.encode_block(ids, lengths, huffman.canonical_codes(lengths))
        decoding = huffman.decoding_table(lengths)
        assert (huffman.decode_block(data, *decoding) == ids).all()
        if n > 300:
            assert (huffman.decode_block(data, *decoding, first=2) == ids[2 * huffman.CHECKPOINT :]).all()


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 300)
    monkeypatch.setattr(huffman, "MERGE", 2)
    rows = HARD + [(20 + i, r.text) for i, r in enumerate(table(spark, "documents").limit(40).collect())]
    name = "byte_bpe_50k.json"
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in huffman.token_round_trip(docs_of(spark, rows).repartition(5), tokenizer_file(name)).collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids, at, expected = all_ids(ordered, name, 2), 0, []
    for (d, _), x in zip(ordered, ids, strict=True):
        expected.append((d, at, len(x), crc(x)))
        at += len(x)
    assert sorted(got, key=lambda r: r[1]) == expected
    assert huffman.token_round_trip(docs_of(spark, []), tokenizer_file(name)).count() == 0


def test_packing(spark):
    rows = HARD + [(20 + i, r.text) for i, r in enumerate(table(spark, "documents").limit(60).collect())]
    name = "word_bpe_49k.json"
    got = packing.pack_documents(docs_of(spark, rows), tokenizer_file(name), with_ids=False).toPandas()
    expected = []
    for (d, _), x in zip(rows, all_ids(rows, name, 1), strict=True):
        expected += [(d, p, s, len(x[s : s + 4096]), crc(x[s : s + 4096])) for p, s in enumerate(range(0, len(x), 4096))]
    key = lambda r: str([None if v is None or v != v else int(v) for v in r])
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).values.tolist())) == sorted(map(key, expected))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 4096 and (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all()
    assert got.sequence_id.nunique() <= got.length.sum() // 4096 + 2
    whole = packing.pack_documents(docs_of(spark, HARD), tokenizer_file(name), with_ids=True).collect()
    assert len(whole) == sum(-(-len(x) // 4096) for x in all_ids(HARD, name, 1)) and all(crc(r.ids) == r.ids_crc32 for r in whole)
    assert packing.pack_documents(docs_of(spark, []), tokenizer_file(name)).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs_of(spark, rows), tokenizer_file(name), max_attention=10)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.sort(np.random.default_rng(4).integers(1, 100, 500))[::-1]
    bins, offsets = packing.best_fit(lengths, (100, 7, 4000), rule=rule) if (lengths**2).max() <= 4000 else packing.best_fit(np.minimum(lengths, 63), (100, 7, 4000), rule=rule)
    used = np.minimum(lengths, 63) if (lengths**2).max() > 4000 else lengths
    for b in range(bins.max() + 1):
        own = used[bins == b]
        assert own.sum() <= 100 and len(own) <= 7 and (own**2).sum() <= 4000
        assert sorted(offsets[bins == b]) == [0, *np.cumsum(own[np.argsort(offsets[bins == b])])[:-1]]


# --- Language and quality


def test_language(spark):
    rows = language_id.identify_languages(table(spark, "documents"))
    got = rows.join(table(spark, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) and (held.lang_pred == held.lang).mean() > 0.9
    assert ((zlib.crc32(b"%d" % d) % 4 == 2) == h for d, h in zip(got.doc_id, got.held_out, strict=True))
    hard = language_id.identify_languages(docs_of(spark, HARD)).collect()
    by = {(r.doc_id, r.lang_pred, r.score) for r in hard}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (10, "und", 0.0)} <= by and len(hard) == len(HARD)
    assert language_id.identify_languages(docs_of(spark, [])).count() == 0
    none = docs_of(spark, HARD).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify_languages(none).collect()} == {"und"}
    kept = language_id.keep_known(docs_of(spark, HARD))
    assert kept.columns == docs_of(spark, []).columns and {r.doc_id for r in kept.collect()} == {None, 4, 5, 7, 8, 9}


def test_mixture_proportions():
    """EM against a direct search of the likelihood's maximum, and a text of two languages."""
    rng = np.random.default_rng(5)
    like = rng.random((300, 2)) + 1e-3
    share, value = language_id._em(like, np.array([0, 300]), np.zeros(300, int), np.full((1, 2), 0.5), 2000)
    grid = np.linspace(1e-4, 1 - 1e-4, 20_001)
    best = grid[np.argmax(np.log(np.outer(like[:, 0], grid) + np.outer(like[:, 1], 1 - grid)).sum(0))]
    assert abs(share[0, 0] - best) < 1e-2


def test_quality(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    got = quality.score_quality(docs, labels).join(labels, "doc_id").toPandas()
    assert ((got.score >= 0.3).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
    assert (got[~got.held_out].predicted == got[~got.held_out].quality).mean() > 0.95
    assert got.held_out.sum() > 10 and (got[got.held_out].predicted == got[got.held_out].quality).mean() > 0.9
    hard = quality.score_quality(docs_of(spark, HARD), labels.limit(0)).collect()
    assert {r.score for r in hard} == {0.5} and len(hard) == len(HARD)
    odd = spark.createDataFrame([(4, 1, 0), (4, None, 0), (None, 1, 0), (7, 0, 1), (7, 1, 1), (99, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    hard = quality.score_quality(docs_of(spark, HARD), odd).collect()
    assert len(hard) == len(HARD) and all(0 <= r.score <= 1 for r in hard)
    assert quality.score_quality(docs_of(spark, []), labels).count() == 0


def test_attention_finds_passages():
    """Bags with one bad passage are found from the bags' labels alone."""
    rng = np.random.default_rng(6)
    bags, y = [], []
    for i in range(300):
        h = rng.normal(0, 1, (int(rng.integers(1, 6)), quality.DIM)).astype(np.float32)
        if i % 2:
            h[int(rng.integers(len(h))), :5] += 6
        bags.append(h)
        y.append(float(i % 2))
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    p = quality.fit(np.concatenate(bags), bounds, np.array(y))
    s = quality._scored(p, np.concatenate(bags), bounds)
    assert ((s > 0.5) == np.array(y)).mean() > 0.95


# --- Decontamination


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(7)
    for _ in range(30):
        a, b = rng.integers(2, 8, (1, 12)).astype(np.uint64), rng.integers(2, 8, (1, 20)).astype(np.uint64)
        assert decontaminate.align(a, b)[0][0] == brute_align(a[0], b[0])


def test_contamination(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words, 25))) for i in range(8)] + [(8, None), (9, "too short"), (10, ""), (None, " ".join(rng.choice(words, 25)))]
    clean = " ".join(rng.choice(words, 200))
    edited = items[1][1].split()
    edited[5] = edited[12] = "changed"
    edited.insert(18, "more")
    rows = [(1, f"{clean} {items[0][1].upper()}, {clean}"), (2, f"{clean} {' '.join(edited)}"), (3, clean), (4, None), (5, ""), (None, items[2][1]), (7, items[3][1]), (7, items[3][1]), (8, " ".join([items[4][1]] * 300)), (9, " ".join(x[1] for x in items[:2]))]
    rows += [(100 + i, items[5][1]) for i in range(200)]  # an item that leaked very often keeps its seeds
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs_of(spark, rows), bench).collect()
    found = sorted((str(r.doc_id), str(r.item_id)) for r in got)
    assert found == sorted([("1", "0"), ("2", "1"), ("None", "2"), ("7", "3"), ("7", "3"), ("8", "4"), ("9", "0"), ("9", "1"), *((str(100 + i), "5") for i in range(200))])
    exact = next(r for r in got if r.doc_id == 1)
    assert (exact.score, exact.first_word, exact.last_word) == (1.0, 200, 224)
    assert math.isclose(next(r for r in got if r.doc_id == 2).score, brute_align(items[1][1].split(), edited) / 50)
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs_of(spark, rows), bench).collect()) == [3, 4, 5]
    assert decontaminate.find_contamination(docs_of(spark, []), bench).count() == 0
    assert decontaminate.find_contamination(docs_of(spark, rows), bench.limit(0)).count() == 0
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)  # several blocks find the same
    again = decontaminate.find_contamination(docs_of(spark, rows), bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in again) == found


@pytest.mark.parametrize("n", [24, 40, 80, 120])
@pytest.mark.parametrize("every", [4, 5])
def test_edited_copies_keep_their_seeds(spark, n, every):
    rng = np.random.default_rng(9)
    item = [f"v{i}" for i in rng.permutation(400)[:n]]
    edited = [f"z{i}" if i % every == every - 1 else w for i, w in enumerate(item)]  # 25 or 20 % replaced, in one document
    random = [f"z{i}" if x else w for i, (w, x) in enumerate(zip(item, rng.random(n) < 0.28, strict=True))]
    rows = [(1, "some words before it " + " ".join(edited)), (2, " ".join(random)), (3, "no item in here but " + " ".join(item[:4]))]
    rows += [(10 + i, " ".join(item)) for i in range(3)]  # exact copies must not take the seeds of edited ones
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    scores = {i: brute_align(item, t.split()) / (2 * n) for i, t in rows}
    got = {r.doc_id: r.score for r in decontaminate.find_contamination(docs_of(spark, rows), bench).collect()}
    assert got == {i: x for i, x in scores.items() if x >= 0.5} and 1 in got
    assert decontaminate.find_contamination(docs_of(spark, rows[:1]), bench).count() == 1


def test_short_items_and_words_of_any_script(spark):
    han, thai = "机器学习模型的训练数据不能包含测试题目", "ข้อมูลทดสอบต้องไม่อยู่ในชุดฝึก"
    latin = " ".join(f"w{i}" for i in range(20))
    items = [(1, "What is the capital of France?"), (2, han), (3, thai), (4, latin), (5, "日本"), (6, "yes"), (7, "?!"), (8, "What is the capital of France?")]
    rows = [(1, "x. What is the\u00a0capital of “France” then, what is the capital of France"), (2, "what is the capital city of France"), (3, f"前文{han}。后文"), (4, f"ก {thai} ข")]
    rows += [(5, latin.replace(" ", "\u3000")), (6, "—".join(f"“w{i}”" for i in range(20))), (7, "在日本語"), (8, "yesterday"), (9, "Yes"), (10, "日 x 本"), (11, "…"), (12, "what is the capital of"), (13, "France")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs_of(spark, rows).coalesce(1), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 8), (3, 2), (4, 3), (5, 4), (6, 4), (7, 5), (9, 6)]
    assert all(r.score == 1.0 for r in got) and next((r.first_word, r.last_word) for r in got if r.doc_id == 1) == (1, 6)
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs_of(spark, rows), bench).collect()) == [2, 8, 10, 11, 12, 13]


# --- WARC

PAGES = "page_id long, url string, html string, digest string, last long"


def test_loser_tree():
    rng = np.random.default_rng(9)
    for k in (0, 1, 2, 3, 5, 16, 33):
        streams = [sorted((str(v), "t", int(v)) for v in rng.integers(0, 9, int(rng.integers(0, 9)))) for _ in range(k)]
        assert list(warc.LoserTree([iter(s) for s in streams], warc._key)) == sorted((r for s in streams for r in s), key=warc._key)


def test_url_keys():
    assert warc.url_key("HTTPS://user@www.Example.com:443/a?b#c") == "com,example)/a?b"
    assert warc.url_key("http://a.b") == "b,a)/" and warc.url_key(None) == "" and warc.url_key("x:8") == "x:8"


def test_warc(spark, monkeypatch):
    for k, v in {"RANGE_ROWS": 40, "GROUP_ROWS": 8, "RUN_ROWS": 16, "FAN_IN": 3, "ARCHIVE_BYTES": 20_000}.items():
        monkeypatch.setattr(warc, k, v)
    big, other = "x" * 1000, "é" * 600
    rows = [(i, "http://hot.example/", big, "d", 0) for i in range(60)] + [(100, None, None, "d", 0), (101, "", "", None, None), (102, "http://a.b/c d\r\n", "short", "d", 0), (103, "u", "short", "d", 0), (None, "v", other, "d", 0), (104, "v", other, "d", 0), (105, "v", other, "d", 0), (105, "v", other, "d", 0), (106, "w", "<p>\r\n\r\n</p>" * 200, "d", 0)]
    got = warc.capture_histories(spark.createDataFrame(rows, PAGES).repartition(4)).collect()
    last = {}
    for p, _, h, *_ in rows:
        if p is not None and len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, -1), p)
    import hashlib

    expected = []
    for p, _, h, *_ in rows:
        revisit = h in last and last[h] != p
        expected.append((p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(expected, key=str)
    order = [(r["range"], warc._key((r.url_key, r.captured, r.page_id))) for r in got]
    assert sorted(order) == sorted(order, key=lambda x: x[1]) and len({r["range"] for r in got}) > 1
    assert warc.capture_histories(spark.createDataFrame([], PAGES)).count() == 0


def test_row_groups_of_a_pass(spark, tmp_path, monkeypatch):
    """Of any number of runs, a pass meets each row group about once, and no range is much longer than it should be."""
    for k, v in {"RANGE_ROWS": 1_000, "GROUP_ROWS": 50, "FAN_IN": 4}.items():
        monkeypatch.setattr(warc, k, v)
    columns = "number long, part int, run string, group int, rows long, url_key string, captured string, page_id long"
    for runs in (8, 32):
        rows = [(n, 0, f"r{n:03}", g, 50, f"u{g:05}", "t", n) for n in range(runs) for g in range(40)]
        got = warc.placed(spark.createDataFrame(rows, columns), f"{tmp_path}/{runs}").collect()
        assert {(r.run, r.group) for r in got} == {(r[2], r[3]) for r in rows}
        assert len(got) <= 1.5 * len(rows)
        per_range = {}
        for r in got:
            per_range[r.team, r["range"]] = per_range.get((r.team, r["range"]), 0) + 50
            assert r.high is None or r.low < r.high
        assert max(per_range.values()) <= 1_000 + 2 * 4 * 50 and len({t for t, _ in per_range}) == runs // 4
    # Groups that all begin with one key are one range.
    same = [(n, 0, f"r{n}", g, 50, "u", "t", None) for n in range(3) for g in range(40)]
    got = warc.placed(spark.createDataFrame(same, columns), f"{tmp_path}/same").collect()
    assert len(got) == 120 and len({r["range"] for r in got}) == 1


def test_broken_archive():
    import gzip
    import io

    whole = gzip.compress(warc.record(1, "http://a/", "t", b"p", "00" * 20, None, False))
    assert [x[:2] for x in warc.read_records(io.BytesIO(whole + whole))] == [(0, len(whole)), (len(whole), len(whole))]
    with pytest.raises(ValueError, match="within a record"):
        list(warc.read_records(io.BytesIO(whole[:-3])))


# --- HTML


def test_html_layout():
    r = html_text.render
    assert r(None) == r("") == r("<!-- x -->") == ""
    assert r("a<b>b</b> c\n d") == "ab c d"
    assert r("<p>one<p>two<div>three</div>four<br>five") == "one\n\ntwo\n\nthree\nfour\nfive"
    assert r("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>") == "- a\n- b\n  3. c\n  4. d"
    assert r("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x<td>22</table>") == "Name       N\nlong name  1\nx          22"
    assert r("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide one</table>") == "a  b\n   c\nwide one"
    assert r("<pre>a\n  b</pre>") == "a\n  b"
    assert r("<title>t</title><style>s</style>x<script>if (a<b) '</p>'</script>y<template>z</template>") == "xy"
    assert r("a<span hidden>b</span><i style='DISPLAY : none'>c<b>d</b></i>e<div style='visibility:hidden'>f</div>") == "ae"
    assert r("<details><summary>s</summary>no<p>no</p></details><details open><summary>t</summary>yes</details>") == "s\nt\nyes"
    assert r("&lt;p&gt; &amp;copy; &eacute;&#233;&nbsp;x") == "<p> &copy; éé x"
    assert r("</p></div>a<td>b</table><li>c") == "ab\n- c" and r("<") == "<" and r("a < b") == "a < b"


def test_html_raw_text_ends_where_it_does():
    r = html_text.render
    assert r("<title>t</title><p>İstanbul</p><style>s</STYLE><p>x</p><script>İ</Script>y") == "İstanbul\n\nx\n\ny"
    assert r("<textarea>İ &amp; a</textarea>b") == "İ & ab"
    assert r("a<style>b</ſtyle>c</style>d") == "ad"  # only ASCII letters fold


def test_html_without_end_of_head():
    r = html_text.render
    assert r("<html><head><title>t</title><body><p>x</p></body></html>") == "x"
    assert r("<head><meta charset=utf-8><style>s</style><div>x</div>y") == "x\ny"
    assert r("<head><title>t</title> \n text<p>x") == "text\n\nx" and r("<head><noscript><link><img>a</noscript>b") == "ab"
    assert r("<head> \n<script>s</script><template><p>t</p></template></head><p>x") == "x"


def test_html_svg_and_math():
    r = html_text.render
    assert r("<p><svg class='i'/> text</p>") == r("<p><svg class=i /> text</p>") == r("<p><svg><path d='M0'/><title>t</title></svg> text</p>") == "text"
    assert r("a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> b") == "a x= 1 2 b"
    assert r("<math><semantics><mi>x</mi><annotation>\\x</annotation></semantics></math>y <desc>z</desc>") == "xy z"
    assert r("<svg><defs><text>no</text></defs><desc>no</desc><title/><text>a<tspan>b</tspan></text><text><![CDATA[c<d]]></text></svg>e") == "ab c<d e"
    assert r("<svg><foreignObject><p>one<br/><div/>two</foreignObject></svg>three").split() == ["one", "two", "three"]
    assert r("<svg><defs><g><p>out of it</p>") == "out of it" and r("<svg><text display=none>no</text></svg>x<div/>y") == "x\ny"
    assert r("<svg><a href=x/>l</a></svg>m") == "lm" and r("<svg>" + "<g>" * 30_000 + "<text>x") == "x"


@pytest.mark.parametrize("evil", ["<b>" * 30_000 + "x", "<p>" * 20_000, "<table><tr><td>" * 500, "<ul><li>" * 500, '<a b="' * 5_000, "<!--" * 5_000, "<" * 20_000, "<script>" * 3_000, "<b>" * 20_000 + "</i>" * 20_000])
def test_html_never_fails(evil):
    assert isinstance(html_text.render(evil), str)


def test_html_query(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a", 5), (1, "u", "<p>a", 5), (None, None, None, None), (3, "u", "", 1)], "page_id long, url string, html string, text long")
    assert sorted(map(str, ((r.page_id, r.text, r.n_chars) for r in html_text.extract_text(rows).collect()))) == sorted(map(str, [(1, "a", 1), (1, "a", 1), (None, "", 0), (3, "", 0)]))
    pages = html_text.extract_text(table(spark, "pages")).collect()
    assert all(r.text and "<script" not in r.text and "track(0)" not in r.text for r in pages)


# --- Neighbours


def test_nearest(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.2, 3, (900, 1))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist(), 0) for i in range(300)]  # a third are equal
    bad = [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [math.nan] * 16, 0), (2060, [math.inf] + [1.0] * 15, 0), (2080, [None] + [1.0] * 15, 0), (None, x[1].tolist(), 0), (40, x[40].tolist(), 0), (3000, [1.0, 2.0], 0), (3001, [2.0, 1.0], 0)]
    t = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank int")
    got = nearest(t, shard_nodes=300).toPandas()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hit = 0
    for q in [i for i in ids if i % 20 == 0]:
        s = m @ x[0 if q >= 1000 else q]
        keep = ids != q
        top = ids[keep][np.lexsort((ids[keep], -np.round(s[keep], 12)))[:20]]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        assert np.allclose(own.score, (m @ x[0 if q >= 1000 else q])[np.searchsorted(ids, own.vec_id)])
        hit += len(set(top) & set(own.vec_id))
    assert hit / (20 * len([i for i in ids if i % 20 == 0])) > 0.95
    assert set(got.query_id) == {i for i in ids if i % 20 == 0} | {3000}
    assert got[got.query_id == 3000][["vec_id", "score"]].values.tolist() == [[3001, 4.0]]
    assert nearest(t.limit(0)).count() == 0
    assert nearest(t.where("vec_id = 20")).count() == 0


# --- Compaction


def test_compaction(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    docs = docs_of(spark, HARD)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(compacted(docs, root, rows_per_shard=2), docs)
    store = ShardStore(spark, root)
    assert len(store.manifest(1)["shards"]) > len(store.manifest()["shards"]) and same(store.read(1), docs)
    for _ in range(5):
        store.append(docs)
    before, old = store.version(), store.read().count()
    after = store.compact(target=1 << 20, fanout=2)
    assert after > before and store.read().count() == old == 6 * len(HARD) and same(store.read(1), docs)
    with pytest.raises(CommitConflict):
        store.commit(1, {}, [], docs.schema.json())
    assert store.version() == after
    with pytest.raises(ValueError, match="other columns"):
        store.append(docs.select("doc_id"))
    assert store.vacuum(keep=1) > 0 and store.read().count() == old
    assert compacted(docs.limit(0), f"file://{tmp_path}/empty").count() == 0


# --- Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs, seen = table(spark, "documents"), []
    columns = docs.columns
    bench = [" ".join(re.findall(r"\w+", r.text.lower())) for r in table(spark, "benchmark").collect()]
    folder = c.work_dir(spark, "test-pipeline")
    for name, f in c.STAGES:
        out = c.stage(f(spark, docs, D), f"{folder}/{name}")
        if name != "pack":
            assert out.columns == columns and out.exceptAll(docs).count() == 0
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            firsts = {x[2] for x in brute_components(rows, 5, 80)}
            assert {r.doc_id for r in out.collect()} == firsts
        if name == "decontaminate":
            has = {r.doc_id for r in docs.collect() if any(b in " ".join(re.findall(r"\w+", r.text.lower())) for b in bench)}
            assert has and not has & {r.doc_id for r in out.collect()}
        if name == "pack":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        seen.append(out.count())
        docs = out
    assert [n for n, _ in c.STAGES] == ["language_id", "quality", "near_duplicates", "decontaminate", "pack"] and all(seen)


def test_near_duplicates_of_repeated_ids(spark):
    import corpus_pipeline as c

    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, one), (2, one), (2, two), (3, three), (3, three), (4, three), (None, two + " x"), (None, "null " + one[::-1]), (None, "null " + one[::-1]), (5, None), (5, None), (6, "")]
    got = c.near_duplicates(spark, docs_of(spark, rows).repartition(3), D)
    assert got.columns == docs_of(spark, rows).columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(1, one), (2, two), (3, three), (None, "null " + one[::-1]), (5, None), (5, None), (6, "")]))
    assert c.near_duplicates(spark, docs_of(spark, []), D).count() == 0


def test_language_filter_without_languages(spark):
    rows = [(1, "some text"), (2, "日本"), (3, None), (4, ""), (5, "12 … !"), (None, "no id"), (6, "… é")]
    docs = docs_of(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    assert [r.text for r in language_id.keep_known(docs).collect()] == ["some text", "日本", "no id", "… é"]
    held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    assert language_id.keep_known(docs_of(spark, [(held_out, "some text"), (held_out, "...")])).count() == 1


def test_queries_equal_sql(spark):
    import glob
    import os

    import duckdb

    from allelake.llm.oracles import ORACLE
    from allelake.llm.queries import QUERIES

    duck = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    value = lambda v: None if v is None or v != v else str(int(v)) if isinstance(v, (int, float)) else v
    for name, sql in ORACLE.items():
        got, expected = QUERIES[name](spark, D).toPandas(), duck.execute(sql).df()
        names = sorted(got.columns)
        assert names == sorted(expected.columns)
        rows = lambda x: sorted((tuple(value(v) for v in r) for r in x[names].astype(object).where(x[names].notna(), None).itertuples(index=False, name=None)), key=str)  # noqa: B023, E731
        assert rows(got) == rows(expected), name
