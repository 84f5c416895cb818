"""Training-data operators on inputs made to break them: tight clusters, hostile tables, long items, short texts, hard rows."""

import threading
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allelake.llm import common, decontaminate, hnsw, html_text, jaccard_join, language_id, packing, quality, tokens
from allelake.llm.compaction import ShardStore
from allelake.llm.queries import tokenizer_file
from tests.llm.test_llm import HARD, D, docs_of, table


# --- Jaccard join


def test_short_texts_fill_no_bucket():
    """Unrelated texts of a few words share no key, though most of a small set's segments are empty."""
    rng = np.random.default_rng(1)
    for words, percent in [(w, p) for w in (5, 7, 9, 12, 16, 30, 70, 150) for p in (80, 85)]:
        text = [" ".join(f"w{v}" for v in row) for row in rng.integers(0, 10**9, (5_000, words))]
        batch = pa.record_batch({"doc_id": pa.array(range(5_000)), "text": text})
        keys = np.concatenate([x.column("key").to_numpy() for x in jaccard_join._key_batches(4, percent)([batch])])
        assert np.unique(keys, return_counts=True)[1].max() <= 8, (words, percent)


def test_short_texts_still_link(spark):
    """Every pair of small sets that may link shares a key."""
    rng = np.random.default_rng(2)
    lows = jaccard_join.bands(200)
    for n in (6, 7, 8, 13, 14, 20, 33):
        for _ in range(200):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[: n - int(rng.integers(0, 1 + n * 15 // 100))], rng.integers(0, 2**63, int(rng.integers(0, 2))).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both):
                continue
            found = []
            for x in (np.sort(a), np.sort(b)):
                own = np.searchsorted(lows, len(x), "right") - 1
                band = np.array([own, max(0, own - 1)][: 1 + (own > 0 and 100 * (lows[own] - 1) >= 85 * len(x))])
                _, parts, deals = jaccard_join.segments(lows, 85)
                doc = np.zeros(len(band), np.int64)
                out = jaccard_join._keys_of(x, np.array([0, len(x)]), doc, band, 85, parts, deals, np.array([1]))
                found.append(set(np.concatenate([y.column("key").to_numpy() for y in out]).tolist()))
            assert found[0] & found[1], n


def test_likeliest_candidates():
    a, b = np.array([1, 2, 3, 4]), np.array([5, 6, 7, 8])
    got = jaccard_join._likeliest(a, b, np.array([1, 1, 1, 2]), np.array([5, 5, 5, 8]), np.array([0.3, 0.1, 0.2, 0.5]), 2).to_pylist()
    assert got == [{"a": 2, "b": 6, "more": True}, {"a": 3, "b": 7, "more": True}, {"a": 4, "b": 8, "more": False}]


# --- Decontamination


def test_very_long_item(spark):
    rng = np.random.default_rng(3)
    item = [f"w{v}" for v in rng.integers(0, 50_000, 100_000)]
    edited = list(item[:2_000])
    edited[::9] = ["x"] * len(edited[::9])
    rows = [(1, "before it " + " ".join(item) + " after"), (2, " ".join(item[:40_000])), (3, " ".join(rng.permutation(item)[:3_000])), (4, " ".join(edited))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:2_000]))], "item_id long, text string")
    got = decontaminate.find_contamination(docs_of(spark, rows), bench, least=0.6).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (1, 2), (2, 2), (4, 2)}
    assert next((r.score, r.first_word, r.last_word) for r in got if (r.doc_id, r.item_id) == (1, 1)) == (1.0, 2, 100_001)


def test_windows_are_bounded(monkeypatch):
    """However few cells a batch of windows may have, the matches are the same."""
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{v}" for v in rng.integers(0, 80, n)]
    items = [(i, " ".join(words(int(rng.integers(9, 60))))) for i in range(30)]
    texts = [" ".join([*words(20), *it.split()[: int(rng.integers(8, 60))], "x", *words(9)]) for _, it in items]
    block = decontaminate._block(items, 8)
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])])
    whole = decontaminate._matches(block, *decontaminate._text_words(raw, off), 0.5)
    monkeypatch.setattr(decontaminate, "CELLS", 100)
    assert decontaminate._matches(block, *decontaminate._text_words(raw, off), 0.5) == whole and len(whole) >= 15


# --- Packing


@pytest.mark.parametrize("what,capacity", [("max_documents", 3), ("max_attention", 250_000)])
@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_each_capacity_binds_alone(spark, what, capacity, rule):
    rows = [(i, "word " * (1 + i * 37 % 400)) for i in range(120)]
    free = packing.pack_documents(docs_of(spark, rows), tokenizer_file("word_bpe_49k.json"), rule=rule).toPandas()
    got = packing.pack_documents(docs_of(spark, rows), tokenizer_file("word_bpe_49k.json"), rule=rule, **{what: capacity}).toPandas()
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert got[key].sort_values(key).values.tolist() == free[key].sort_values(key).values.tolist()
    over = lambda t: sum((len(g) > capacity if what == "max_documents" else (g.length**2).sum() > capacity) for _, g in t.groupby("sequence_id"))
    assert over(free) > 0 and over(got) == 0 and got.sequence_id.nunique() > free.sequence_id.nunique()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 4096 and (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all()


def test_best_fit_against_brute_force():
    """Every piece is placed as a plain search over all open sequences places it."""
    lengths = np.sort(np.random.default_rng(5).integers(1, 60, 150))[::-1]
    cap, weights = (100, 5, 5_000), (1.0, 0.5, 0.7)
    bins, _ = packing.best_fit(lengths, cap, weights)
    room, score = [], []
    for m, b in zip(lengths.tolist(), bins.tolist(), strict=True):
        need = (m, 1, m * m)
        fits = [i for i, r in enumerate(room) if all(x >= y for x, y in zip(r, need, strict=True))]
        score = {i: sum(w * ((x - y) / c) ** 2 for x, y, c, w in zip(room[i], need, cap, weights, strict=True)) for i in fits}
        if fits:
            assert score[b] <= min(score.values()) + 1e-12
        else:
            assert b == len(room)
            room.append(cap)
        room[b] = tuple(x - y for x, y in zip(room[b], need, strict=True))


# --- Nearest neighbours


def test_tight_clusters_are_reachable():
    rng = np.random.default_rng(6)
    center = rng.normal(size=(40, 24)) * 5
    x = (np.repeat(center, 100, 0) + rng.normal(size=(4_000, 24)) * 0.05).astype(np.float32)
    x = x[rng.permutation(len(x))]
    graph = hnsw.build(x, np.arange(len(x)), float(np.sqrt((x.astype(float) ** 2).sum(1).max())))
    for i in range(int(graph["levels"][0]) + 1):  # every member of a level can be reached from its first one
        members, links, where = graph[f"members{i}"], graph[f"links{i}"], graph[f"where{i}"]
        seen = np.zeros(len(members), bool)
        hnsw._reach(np.where(links >= 0, where[np.maximum(links, 0)], -1), seen, np.array([0]))
        assert seen.all()
    q = np.arange(0, len(x), 20)
    found, _ = hnsw.find(graph, x[q].astype(float), 20)
    s = x[q].astype(float) @ x.T.astype(float)
    least = np.sort(s, 1)[:, -20]
    recall = np.array([(s[i, found[i][found[i] >= 0]] >= least[i] - 1e-9).sum() / 20 for i in range(len(q))])
    assert recall.mean() >= 0.95 and recall.min() >= 0.5


# --- HTML


def test_hostile_tables():
    began = time.time()
    source = "<table><tr><td>" + "a" * 100_000 + "<td>b" + "<tr><td>s<td>t" * 200 + "</table>"
    out = html_text.render(source)
    assert len(out) < len(source) and out.splitlines()[1] == "s  t"
    assert len(html_text.render("<table>" + "<tr><td colspan=1000 rowspan=65534>x" * 2_000 + "</table>").split()) == 2_000
    assert html_text.render("<table>" + ("<tr>" + "<td colspan=1000 rowspan=9>x" * 100) * 20 + "</table>").count("x") == 2_000
    assert time.time() - began < 20


def test_table_layout_does_not_depend_on_its_length():
    for n in (5, 64, 65, 3_000):
        out = html_text.render("<table><tr><td>" + "a" * 1_000 + "<td>b<tr><td>sss<td>t" + "<tr><td>s<td>t" * n + "</table>").splitlines()
        assert out == ["a" * 1_000 + "  b", "sss  t"] + ["s    t"] * n
        out = html_text.render("<table><tr><td>" + "a" * 500 + "<td>b" + "<tr><td>s<td><td>t" * n + "</table>").splitlines()
        assert out == ["a" * 500 + "  b"] + ["s" + " " * 504 + "t"] * n
        tall = html_text.render("<table><tr><td>" + "a" * 300 + "<td><pre>" + "x\n" * n + "</pre></table>").splitlines()
        assert tall == ["a" * 300 + "  x"] + [" " * 302 + "x"] * (n - 1)
    assert html_text.render("<table><tr><td>ab<td><td>z<tr><td colspan=2>abcd<td>y</table>") == "ab    z\nabcd  y"


def test_table_padding_is_linear():
    wide, began = "<tr>" + ("<td>" + "a" * 500) * 300, time.time()
    for rest in ("<tr><td colspan=299>b<td>x" * 3_000, "<tr><td rowspan=9999 colspan=299><td>x" + "<tr><td>x" * 6_000, "<tr>" + "<td>" * 299 + "<td><pre>" + "x\n" * 30_000):
        out = html_text.render("<table>" + wide + rest)
        assert out.count("x") == rest.count("x") and out.count("a") == 150_000 and len(out) < 300 * len(wide + rest)
    nested = "x"
    for _ in range(30):
        nested = "<table><tr><td>" + "a" * 500 + "<td>b<tr><td><td>" + nested + "<br>x" * 50 + "</table>"
    out = html_text.render(nested)
    assert out.count("x") == 1_501 and len(out) < 300 * len(nested) and time.time() - began < 20


def test_long_texts_go_batch_by_batch(spark, monkeypatch):
    monkeypatch.setattr(html_text, "BATCH_BYTES", 10)
    rows = [(i, "<p>" + "x" * (i % 7)) for i in range(600)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(i, "x" * (i % 7), i % 7) for i in range(600)]


def test_spans():
    r = html_text.render
    assert r("<table><tr><td>a<td>bbb<tr><td colspan=2>wide wide<td>z<tr><td rowspan=2>q<td>r<td>s<tr><td>t<td>u</table>") == "a  bbb\nwide wide  z\nq  r       s\n   t       u"


def test_visibility():
    r = html_text.render
    assert r("<div style='visibility:hidden'>no<p style='visibility: visible'>yes</p>no</div>after") == "yes\n\nafter"
    assert r("<div style='display:none'>no<p style='visibility:visible;display:block'>no</p></div>after") == "after"
    assert r("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>") == "- yes"
    assert r("<p hidden>no</p><p hidden style='display:block'>yes</p>") == "yes"


def test_style_rules():
    r = html_text.render
    page = "<style>/* .a{display:none} */ .x{display:none} #y{visibility:hidden} @media print{p{display:none}} b.z, i {display:none!important} .o{display:none} .o{display:inline} p .a{display:none}</style>"
    assert r(page + "<p class='a x'>no</p><p class=a>p</p><p id=y>no</p><b class=z style='display:block'>no</b><b>bold</b><i>no</i><u class=o>on</u>") == "p\n\nboldon"
    assert r("<style>p{display:none</style><p>no</p><div>x") == "x" and r("<style>@media x{p{</style><p>y") == "y"


# --- Language and quality


def test_language_sets(spark):
    """A text of two languages has both, in their proportions; a text of one has one."""
    docs = table(spark, "documents")
    langs, logs = language_id.train(docs.select("text", "lang"))
    by = {}
    for r in docs.where("lang is not null and n_chars between 400 and 6000").orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(" ".join(r.text.split()[:60]))
    one, two = sorted(by)[:2]
    texts = [*by[one][:5], *(f"{a} {b}" for a, b in zip(by[one][:5], by[two][:5], strict=True))]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])])
    found = [{langs[c]: p for c, p in x} for x in language_id.infer(raw, off, logs)]
    assert all(one in x and x[one] > 0.9 for x in found[:5])
    assert sum(set(x) == {one, two} and 0.25 < x[one] < 0.75 for x in found[5:]) >= 4


def test_attention_gradient():
    """The backward step against differences of the loss."""
    rng = np.random.default_rng(7)
    h, bounds, y = rng.normal(size=(9, quality.DIM)), np.array([0, 2, 5, 9]), np.array([1.0, 0.0, 1.0])
    p = {"V": rng.normal(0, 0.05, (quality.DIM, 4)), "U": rng.normal(0, 0.05, (quality.DIM, 4)), "w": rng.normal(0, 0.5, 4), "c": rng.normal(0, 0.1, quality.DIM), "b": np.array([0.1])}
    loss = lambda q: -np.mean(y * np.log(s := quality.forward(q, h, bounds)[0]) + (1 - y) * np.log(1 - s))
    grad = quality.gradient(p, h, bounds, y)
    for k in p:
        for at in [np.unravel_index(int(i), p[k].shape) for i in rng.integers(0, p[k].size, 4)]:
            step = {x: v.copy() for x, v in p.items()}
            step[k][at] += 1e-6
            assert np.isclose((loss(step) - loss(p)) / 1e-6, grad[k][at], rtol=1e-3, atol=1e-7)


def test_fit_takes_long_documents_and_repeats(spark):
    long = "good words here " * 40_000
    rows = [(i, f"good text number {i} " * 9) for i in range(1, 9)] + [(20, long), (21, "1"), (21, "22"), (21, "22")]
    labels = spark.createDataFrame([(i, i % 2) for i in (*range(1, 9), 20, 21)], "doc_id long, quality int")
    weights = [quality.train(docs_of(spark, rows).repartition(n), labels, folds=1, held_out_fold=9) for n in (1, 5)]
    assert all(np.array_equal(weights[0][k], weights[1][k]) for k in weights[0])
    less = quality.train(docs_of(spark, rows), labels, folds=1, held_out_fold=9, sample_bytes=10_000)
    assert not np.array_equal(less["c"], weights[0]["c"])  # the long one was part of the fit


# --- Shared plumbing


def test_workers_keep_one_operators_state():
    tokens.encoder(tokenizer_file("word_bpe_49k.json"))
    common._enter("tokens")
    assert tokens.encoder.cache_info().currsize == 1
    common._enter("graph")
    assert tokens.encoder.cache_info().currsize == 0


def test_piece_table_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "_MOST_PIECES", 50)
    e = tokens.Encoder(tokenizer_file("byte_bpe_50k.json"))
    texts = [" ".join(f"a{i}b{j}" for j in range(30)) for i in range(40)]
    for x in texts:
        raw = np.frombuffer(x.encode(), np.uint8)
        ids, _ = e.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids and e.pieces <= 200


def test_batches_are_bounded_by_bytes(spark):
    sizes = spark.range(300).select(F.repeat(F.lit("x"), 100_000).alias("t")).coalesce(1).transform(common.mapped(lambda bs: (pa.record_batch({"n": [b.nbytes]}) for b in bs), "n long"))
    assert max(r.n for r in sizes.collect()) < 2 * common.BATCH_BYTES


def test_work_is_discarded(spark):
    keep = common.work_dirs()
    path = common.work_dir(spark, "test")
    common.stage(spark.range(3).toDF("a"), f"{path}/t")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    assert common.discard_work(spark, keep) == 1 and not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def test_racing_writers(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/store")
    docs, lock, commit = docs_of(spark, HARD), threading.Lock(), ShardStore.commit

    def one_at_a_time(self, *a):
        with lock:  # a local disk's rename is no single step
            return commit(self, *a)

    try:
        ShardStore.commit = one_at_a_time
        threads = [threading.Thread(target=lambda: [ShardStore(spark, store.root).append(docs) for _ in range(3)]) for _ in range(3)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    finally:
        ShardStore.commit = commit
    assert store.version() == 9 and store.read().count() == 9 * len(HARD)


def test_hard_rows_through_the_pipeline(spark):
    import corpus_pipeline as c

    docs = docs_of(spark, [*HARD, (30, None), (None, None)])
    columns = docs.columns
    for name, f in c.STAGES:
        out = f(spark, docs, D)
        rows = out.collect()
        if name == "pack":
            assert {r.doc_id for r in rows} <= {r[0] for r in HARD} | {30}
        else:
            assert out.columns == columns
            assert {str((r.doc_id, r.text)) for r in rows} <= {str((a, b)) for a, b in [*HARD, (30, None), (None, None)]}
        empty = f(spark, docs.limit(0), D)
        assert empty.count() == 0
