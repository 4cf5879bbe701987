"""The operators for training data against brute force, round trips and edge rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from emberfield.llm import (
    best_two_fit, bpe_ranks, chat_windows, collocations, jaccard_tiles, language_backoff, line_crf, merkle_warc, rank_codes, url_rules, vector_graph,
)
from emberfield.llm.textbatch import Words, flat
from emberfield.llm.tokens import Encoder
from emberfield import session
from emberfield.session import scratch_path

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def _texts(seed: int, n: int) -> list:
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "dé", "x1", "ß", "omega.", "the"]
    out = [" ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(3, 80))) for _ in range(n)]
    for i in range(0, n, 3):
        own = out[i].split()
        own[rng.randrange(len(own))] = "edit"
        out.append(" ".join(own))
    return [*out, *out[:5], None, "", " \t\n", "one two", "ONE two"]


def _docs(spark, texts):
    rows = [(i, t, None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")


def _components(texts):
    """Set size and component of every text, by comparing all pairs."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    return {i: (len(s), r) for i, (s, r) in enumerate(zip(sets, root))}


def _joined(spark, texts):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_tiles.shingle_components(_docs(spark, texts)).collect()}


def test_jaccard_components_equal_brute_force(spark):
    texts = _texts(1, 60)
    assert _joined(spark, texts) == _components(texts)


def test_jaccard_rounds_lose_no_link(spark, monkeypatch):
    """A large group of copies, many just above or below the similarity, with one partner per pivot in a round."""
    for name, value in (("REACH", 1), ("GROWTH", 3), ("FIRST_TILES", 2)):
        monkeypatch.setattr(jaccard_tiles, name, value)
    rounds, reaches = jaccard_tiles._rounds, spark.sparkContext.accumulator(0)

    def counted(batches, keep, comparisons, reach):
        reaches.add(reach)
        return rounds(batches, keep, comparisons, reach)

    monkeypatch.setattr(jaccard_tiles, "_rounds", counted)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(150):
        own = list(base)
        for k in rng.sample(range(200), rng.choice((2, 5, 6, 7))):
            own[k] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    assert _joined(spark, texts) == _components(texts)
    assert reaches.value > 0


def test_a_row_without_id_hides_no_link(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w59", "edit")
    assert _components([text, near])[1][1] == 0
    docs = spark.createDataFrame([(None, text), (5, text), (7, near)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_tiles.shingle_components(docs).collect()}
    assert got == {None: (56, None), 5: (56, 5), 7: (56, 5)}


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300))).astype(np.uint64) for _ in range(2))
        bound = jaccard_tiles.overlap_bound(jaccard_tiles._signature(a), len(a), jaccard_tiles._signature(b), len(b))
        assert bound >= len(np.intersect1d(a, b))


def test_packing_is_gapless_and_full(spark):
    texts = [*_texts(2, 120), "word " * 3000]
    docs = _docs(spark, texts)
    rows = best_two_fit.packed_documents(docs, BYTE, 2).collect()
    encoder = Encoder.of(BYTE).tokenizer
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    sizes = {i: len(encoder.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    for i, size in sizes.items():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in own) == size and [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert all(r.length == 1024 for r in own[1:])
    assert len(by) <= -(-sum(sizes.values()) // 1024) + 1


def test_two_short_pieces_replace_the_smallest():
    counts = np.zeros(11, np.int64)
    for size in (7, 2, 5, 5, 3):
        counts[size] += 1
    bins = best_two_fit.compose(counts, 10)
    assert sum(times for _, times in bins) == 3 and all(sum(own) <= 10 for own, _ in bins)


def test_language_backoff(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    model = language_backoff.fit(spark.createDataFrame([*rows, (99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "the dog", "old"), (2, "hunde", "old"), (3, None, ""), (4, "12 34!", ""), (5, "", "")], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in language_backoff.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert got[3].score == 0 and 0.5 < got[1].score <= 1
    assert {r.lang_pred for r in language_backoff.predict(docs, {"languages": [], "tables": []}).collect()} == {"und"}


def test_crf_decoding_is_the_best_path_and_base_counts_are_exact(spark):
    rng = np.random.default_rng(5)
    model = {"weights": rng.normal(size=(line_crf.FEATURES, 2)), "moves": rng.normal(size=(2, 2))}
    features = (rng.random((14, line_crf.FEATURES)) < 0.4).astype(float)
    bounds = np.array([0, 6, 6, 7, 14])
    got = line_crf.decode(features, bounds, model)
    for a, b in zip(bounds[:-1], bounds[1:]):
        score = lambda p: sum(features[a + i] @ model["weights"][:, y] for i, y in enumerate(p)) + sum(model["moves"][x, y] for x, y in zip(p, p[1:]))
        if b > a:
            assert tuple(got[a:b]) == max(itertools.product((0, 1), repeat=b - a), key=score)
    texts = [*_texts(4, 20), "a b c a b c\nx | y\n\nx | y\n", "# $ é\n"]
    words = Words(*flat(pa.array(texts)))
    counts = line_crf.base_counts(words, line_crf.Lines(words))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expect = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(counts[k][i]) for k in line_crf._BASE) == expect
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert line_crf.fit(_docs(spark, texts), labels) is None
    assert line_crf.judge(_docs(spark, texts), None).count() == len(texts)


def test_crf_learns_shouting_lines(spark):
    good, bad = "this is a plain line of quite ordinary words.\n" * 3, "BUY!! NOW!! CHEAP!! STUFF!! HERE!! TODAY!!\n" * 3
    rows = [(i, (good if i % 2 else bad) + f"line {i}", i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = line_crf.fit(docs.drop("quality"), docs.drop("text"))
    assert all((r.content_share >= 0.5) == bool(r.quality) for r in line_crf.judge(docs, model).collect())


def test_bpe_equals_the_library():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe = bpe_ranks.Bpe.of(path, public_tokenizers.PATTERN)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(7)
    texts = ["".join(rng.choice("abeé ß \n\t12!?#\x0b\x1c 　日😀th") for _ in range(rng.randrange(120))) for _ in range(400)]
    texts += ["a" * 3000, "ab" * 2000, "!" * 1500, " " * 900, None, "", "the " * 300]
    ids, bounds = bpe.encode(pa.array(texts))
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == whole.encode_ordinary(t or "")
        assert bpe.decode(ids[a:b]) == (t or "").encode()
    for path in (WORD, BYTE):
        encoder = Encoder.of(path)
        ids, bounds = encoder.encode(pa.array([*texts, "a<|endoftext|>b <|endoftext|> c"]))
        for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
            assert ids[a:b].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_rank_queue_pops_in_order():
    queue, rng = bpe_ranks.RankQueue(50_000), random.Random(1)
    ranks = {rng.randrange(50_000) for _ in range(500)}
    for r in ranks:
        queue.add(r)
    assert [queue.pop() for _ in ranks] == sorted(ranks) and queue.pop() == -1


def test_value_codes_round_trip_and_files_keep_order(spark):
    values = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 1, 2], np.uint32)
    assert (rank_codes.decode_values(*rank_codes.encode_values(values), len(values)) == values).all()
    texts = _texts(6, 30)
    folder = scratch_path(spark, "codes")
    rank_codes.write(_docs(spark, texts), WORD, 1, folder)
    rows = sorted(rank_codes.read(spark, folder, keep=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    encoder, at = Encoder.of(WORD).tokenizer, 0
    for r, t in zip(rows, texts):
        own = encoder.encode(t or "", add_special_tokens=False).ids + [1]
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == own
        at += len(own)


def test_windows_keep_budget_and_give_turns_back(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(12):
        roles = (["system"] if conv % 3 == 0 else []) + ["user", "assistant"] * rng.randrange(0, 40)
        for turn, role in enumerate(roles):
            rows.append((conv, turn, role, rng.choice(["", "\\", "a </turn> b", "### x: #\\h\\s<", "word " * rng.randrange(400), None])))
    rows.append((50, 0, None, None))
    formatted = chat_windows.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    back = spark.createDataFrame(formatted, "conv_id long, window long, text string, n_context long, loss array<struct<at:long,length:long>>, n_tokens long")
    got, said = {}, {}
    for r in sorted(chat_windows.read_back(back.withColumn("n_context", back.n_context.cast("int"))).collect(), key=lambda r: (r.conv_id, r.window)):
        got.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
        said.setdefault(r.conv_id, []).extend(r.targets)
    for conv in {r[0] for r in rows}:
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert got[conv] == own and said[conv] == [t for r, t in own if r == "assistant"]
    assert all(r.n_tokens <= chat_windows.TARGET + chat_windows.HISTORY + 500 for r in formatted)
    assert any(r.n_context for r in formatted)


def test_audit_finds_exactly_the_damage(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i * 37 % 900)) for i in range(1500)] + [(None, None, None)], "page_id long, url string, html string")
    first = merkle_warc.archive(pages).persist()
    from pyspark.sql import functions as F

    second = first.withColumn("record", F.when(F.col("page_id") == 700, F.lit(b"z")).when(F.col("page_id") == 3, F.lit(None)).otherwise(F.col("record")))
    rows = merkle_warc.audited(first, second).collect()
    assert len(rows) == 1501 and {(r.page_id, r.status) for r in rows if r.status != "ok"} == {(700, "altered"), (3, "missing")}
    assert merkle_warc.audit(merkle_warc.hashes(first), merkle_warc.hashes(first)).count() == 0
    none = merkle_warc.hashes(first.limit(0))
    assert merkle_warc.audit(none, none).count() == 0


def test_records_are_dealt_out_once(spark):
    """One shuffle of the records, by file; equal rows and null ids get places one after the other."""
    pages = spark.createDataFrame([(i % 700, "http://h", "x" * (i % 3)) for i in range(2100)] + [(None, None, None)] * 2, "page_id long, url string, html string")
    made = merkle_warc.archive(pages.repartition(5))
    assert made._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    rows = made.collect()
    for file in {r.file for r in rows}:
        own = sorted((r for r in rows if r.file == file), key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(r.length for r in own[:i]) for i in range(len(own))]
        assert [r.page_id or -1 for r in own] == sorted(r.page_id or -1 for r in own)
    assert len(rows) == 2102


def test_chunks_are_encoded_like_whole_texts():
    """Joined chunks, also ones that hold special tokens or make one together, give the ids of each by itself."""
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        plain, encoder = Tokenizer.from_file(path), Encoder(path)
        chunks = ["It's", " a", " caf\u00e9,", " " + encoder.mark, " <|endof", "text|>", "", " 12 3", "\n\n", "x" * 300]
        for some in (chunks, chunks[:3], chunks[7:], chunks[:3] * 900):
            made = encoder._encode([c.encode() for c in some])
            assert [np.frombuffer(m, np.uint32).tolist() for m in made] == [plain.encode(c, add_special_tokens=False).ids for c in some]


def test_texts_travel_in_small_batches(spark):
    """The operators of the pipeline bound the bytes of a batch, and leave a session's own setting as it is."""
    key, sizes = session._BATCH_BYTES, "n long, size long"

    def seen(batches):
        for b in batches:
            yield pa.record_batch({"n": [b.num_rows], "size": [b.nbytes]})

    docs = spark.createDataFrame([(i, "word " * 20_000, "de") for i in range(300)], "doc_id long, text string, lang string").coalesce(1)
    spark.conf.unset(key)
    try:
        line_crf.judge(docs, None)
        assert max(r.size for r in docs.mapInArrow(seen, sizes).collect()) <= 2 * session.BATCH_BYTES
        spark.conf.set(key, 1 << 20)
        line_crf.judge(docs, None)
        assert int(spark.conf.get(key)) == 1 << 20
    finally:
        spark.conf.unset(key)


def test_memory_goes_back_after_the_last_batch():
    """What an operator worked with is not kept by an idle worker."""
    from emberfield.llm import textbatch

    given = []

    class Pool:
        def release_unused(self):
            given.append(True)

    own, textbatch.pa.default_memory_pool = textbatch.pa.default_memory_pool, Pool
    try:
        parts = textbatch.slices(iter([pa.record_batch({"text": ["a b", None, "c"]})]), "text", 3)
        assert [next(parts).num_rows for _ in range(2)] and not given
        list(parts)
    finally:
        textbatch.pa.default_memory_pool = own
    assert given == [True]


def test_url_rules_and_mined_rules(spark):
    urls = [(i, f"https://{'Ads' if i % 2 else 'news'}.site{i % 3}.example.com/en/{i}.html") for i in range(200)]
    urls += [(900, None), (901, "no scheme"), (902, "http://a.net/x"), (903, "http://X.example.NET/en/1"), (904, "http://example.com/de/1"), (905, "http://org/fr/"), (906, "http://a.net"), (907, "http://badexample.com/de/1")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(150)] + [(None, 0, 0)], "doc_id long, quality int, toxic int")
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    got = {r.page_id: r for r in url_rules.judge(pages, labels, rules).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(200))
    assert [(got[i].rule, got[i].verdict) for i in range(902, 908)] == [
        ("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow")
    ]
    assert (got[900].host, got[900].path, got[901].host) == ("", "", "") and got[903].host == "x.example.net"


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:10] + 0.05 * rng.normal(size=(10, 16)), base[:3], np.repeat(base[5:6], 60, 0) + 0.1 * rng.normal(size=(60, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [])]
    got = {r.vec_id: r for r in vector_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    root = list(range(len(x)))
    for a, b in zip(*np.nonzero(links)):
        p, q = root[a], root[b]
        root = [min(p, q) if r in (p, q) else r for r in root]
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(links[i].sum()) - 1, root[i], root[i] == i)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(900, 905))


def _near_copies(sizes, dim, lone, seed=4):
    """Groups of distinct near copies among lone vectors, shuffled; links and components by comparing all pairs."""
    rng = np.random.default_rng(seed)
    x = [np.repeat(rng.normal(size=(1, dim)), k, 0) + 0.05 * rng.normal(size=(k, dim)) for k in sizes]
    x = rng.permutation(np.concatenate([*x, rng.normal(size=(lone, dim))]))
    near = vector_graph.unit(x) @ vector_graph.unit(x).T >= 0.9
    root = np.arange(len(x))
    while (low := np.where(near, root[None, :], len(x)).min(axis=1)).tolist() != root.tolist():
        root = low
    return x, near.sum(axis=1) - 1, root


def _vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_searches_reach_every_large_group_of_near_copies(spark):
    x, links, root = _near_copies([100, 200, 300, 150], 64, 200)
    got = {r.vec_id: r for r in vector_graph.near_duplicates(_vectors(spark, x)).collect()}
    assert [got[i].component_id for i in range(len(x))] == root.tolist()
    assert sum(r.n_links for r in got.values()) >= 0.999 * links.sum()
    # The graph itself finds them, without the comparison that follows a failed audit.
    y = vector_graph.unit(x)
    assert len(vector_graph.range_search(y, vector_graph.robust_graph(y), y, 0.9)[0]) >= 0.999 * (links.sum() + len(x))


def test_vectors_are_compared_exactly_where_the_audit_falls_short(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "CLUSTER", 100)
    monkeypatch.setattr(vector_graph, "_recall", lambda *_: 0.0)
    x, links, root = _near_copies([70, 90, 2, 3], 16, 235)
    got = {r.vec_id: r for r in vector_graph.near_duplicates(_vectors(spark, x)).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(len(x))] == list(zip(links.tolist(), root.tolist()))


def test_recall_audit_sees_small_groups_beside_a_large_one(spark):
    x, links, _ = _near_copies([250, 2, 2, 2, 2], 16, 100)
    own = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, weight long, vector array<double>")
    some = lambda least: spark.createDataFrame([(i, int(n)) for i, n in enumerate(links) if n >= least], "vec_id long, found long")
    assert vector_graph._recall(own, some(1), 0.9) == 1.0
    # The links of the pairs are less than a thousandth of all.
    assert vector_graph._recall(own, some(100), 0.9) == 0.0


def test_recall_is_audited_at_every_size(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(vector_graph, "_recall", lambda own, counts, low: asked.append(own.count()) or 1.0)
    vector_graph.near_duplicates(_vectors(spark, _near_copies([5], 8, 20)[0])).collect()
    assert asked == [25]


@pytest.mark.parametrize("made", ["jaccard", "pack", "bpe", "crf", "lang", "vectors", "chat"])
def test_empty_tables(spark, made):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    out = {
        "jaccard": lambda: jaccard_tiles.shingle_components(docs),
        "pack": lambda: best_two_fit.packed_documents(docs, BYTE, 2),
        "bpe": lambda: bpe_ranks.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
        "crf": lambda: line_crf.judge(docs, None),
        "lang": lambda: language_backoff.predict(docs, language_backoff.fit(docs)),
        "vectors": lambda: vector_graph.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")),
        "chat": lambda: chat_windows.digests(chat_windows.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
    }[made]()
    assert out.count() == 0


def test_digests_of_a_conversation(spark):
    said = "\\### Assistant: </turn> ok"
    turns = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    row = chat_windows.digests(chat_windows.windows(turns)).first()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (row.loss_chars, row.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_shingles_of_one_document_are_not_posted(spark, monkeypatch):
    """Only shared shingles make tile rows; no link is lost, also with a full filter and without broadcasts."""
    posted, rows = jaccard_tiles._posted, spark.sparkContext.accumulator(0)

    def counted(batches, keep):
        for batch in posted(batches, keep):
            rows.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(jaccard_tiles, "_posted", counted)
    lone = [" ".join(f"d{i}w{k}" for k in range(100)) for i in range(50)]
    assert _joined(spark, lone) == _components(lone)
    # About a quarter of 50 * 96 shingles are in prefixes; the few beyond the counted range are posted.
    assert rows.value < 200
    texts = _texts(1, 60) + lone[:3] + [lone[2].replace("d2w99", "edit")]
    for name, value in (("FEW", 0), ("SHARED_BITS", 1 << 15)):
        monkeypatch.setattr(jaccard_tiles, name, value)
        assert _joined(spark, texts) == _components(texts)
    assert rows.value > 0


def test_finer_chunks_give_the_ids_of_whole_texts(monkeypatch):
    """Chunks that differ in case or in what follows a word are encoded once; odd texts keep the library's ids."""
    from tokenizers import Tokenizer

    odd = ["It's 2nd, 'S don'T x's'll", "H̱ ẖ Å İ İx ẞΣ σΣ.", "a b c　 d e", "\x00\x1c a\x7f b",
           "<|STARTOFTEXT|> x", "a<|endoftext|>b C", "<|startoftext|>", "9a8b 1.5,3 a_b-c!", "  lead\n\n\ttail  ", "café CAFÉ café x" * 40]
    rng = random.Random(5)
    odd += ["".join(rng.choice(" \n\t'.,aAbB19é́ <|>s") for _ in range(200)) for _ in range(60)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        plain, encoder = Tokenizer.from_file(path), Encoder(path)
        for texts in (odd, odd[:4] + odd[7:], *[[t] for t in odd]):
            ids, bounds = encoder.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        made, met = encoder._encode, []
        monkeypatch.setattr(encoder, "_encode", lambda chunks: met.extend(chunks) or made(chunks))
        encoder.encode(pa.array([" zweifelhafter zweifelhafter, zweifelhafter. Zweifelhafter"]))
        assert len(met) <= (3 if name.startswith("word") else 4)


def test_what_a_slice_yields_comes_back_in_small_batches(monkeypatch):
    """A slice of many n-grams is handed back in batches of bounded rows, none of which is lost."""
    monkeypatch.setattr(collocations, "_ROWS", 50, raising=False)
    texts = pa.record_batch({"text": [" ".join(f"w{k}" for k in range(400))], "lang": ["de"]})
    names = [n.split(" ")[0] for n in collocations._SLICES.split(", ")]
    langs, words, *rest = collocations._split(texts)
    lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (langs, words)]
    part = pa.RecordBatch.from_arrays([*lists, *[pa.array([x], pa.binary()) for x in rest]], names)

    class Parts:
        def mapInArrow(self, run, schema):
            return list(run(iter([part])))

    sizes = [b.num_rows for b in collocations._found(Parts(), collocations._words)]
    assert sum(sizes) == 401 and max(sizes) <= 50


def test_tiles_of_a_large_group_yield_few_equal_pairs():
    """Many tiles with the same members bring pairs of different pivots, and none that has had no turn is lost."""
    n = 400
    rep, text = np.arange(n), np.arange(64, dtype=np.uint64)
    bits = [jaccard_tiles._signature(text)] * n
    meta = np.full(n, len(text) << 31)
    tiles = [
        pa.record_batch({"h": np.full(n, h), "rep": rep, "meta": meta, "component": rep, "bits": pa.array(bits, pa.binary())})
        for h in range(20)
    ]
    made = pa.Table.from_batches(jaccard_tiles._rounds(iter(tiles), 75, jaccard_tiles.COMPARISONS, jaccard_tiles.REACH))
    pairs = made.filter(made["a"].is_valid())
    assert 0 < pairs.num_rows <= 20 * jaccard_tiles.PIVOTS * jaccard_tiles.REACH
    assert len(set(zip(*[pairs[c].to_pylist() for c in ("a", "b")]))) > pairs.num_rows // 2
    assert made.num_rows - pairs.num_rows >= 20 * (n - jaccard_tiles.PIVOTS)


def test_tiles_keep_no_member_without_a_partner():
    """Members that no bitmap allows a partner leave in one round, however many there are."""
    n = 400
    rep = np.arange(n)
    rng = np.random.default_rng(4)
    bits = [jaccard_tiles._signature(rng.integers(0, 2**63, 64, dtype=np.uint64)) for _ in range(n)]
    tile = pa.record_batch({"h": np.zeros(n, np.int64), "rep": rep, "meta": np.full(n, 64 << 31), "component": rep, "bits": pa.array(bits, pa.binary())})
    assert sum(b.num_rows for b in jaccard_tiles._rounds(iter([tile]), 75, jaccard_tiles.COMPARISONS, jaccard_tiles.REACH)) == 0


def test_pairs_that_a_pivot_settles_open_no_tile(spark, monkeypatch):
    """Unlike texts that share shingles in twos bring nothing into the rounds."""
    rounds, rows = jaccard_tiles._rounds, spark.sparkContext.accumulator(0)

    def counted(batches, keep, comparisons, reach):
        def seen():
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        return rounds(seen(), keep, comparisons, reach)

    monkeypatch.setattr(jaccard_tiles, "_rounds", counted)
    texts = []
    for i in range(30):
        shared = [f"s{i}w{k}" for k in range(40)]
        texts += [" ".join(shared + [f"{side}{i}w{k}" for k in range(20)]) for side in "ab"]
    assert _joined(spark, texts) == _components(texts)
    assert rows.value == 0


def test_a_doc_id_with_several_sets_and_copies_keeps_all_links(spark):
    """Rows of one doc_id in one tile, copies of a set under other ids, and sets that share a size."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(60):
        own = list(base)
        for k in rng.sample(range(80), rng.choice((0, 1, 2, 3, 4))):
            own[k] = f"e{rng.randrange(40)}"
        rows.append((rng.randrange(40), " ".join(own[: rng.choice((80, 80, 70, 60))])))
    ids = sorted({i for i, _ in rows})
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, w in ((i, t.split()) for i, t in rows)]
    root = {i: i for i in ids}
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if 100 * len(x & y) >= 75 * len(x | y):
            p, q = root[a], root[b]
            root = {i: min(p, q) if r in (p, q) else r for i, r in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in jaccard_tiles.shingle_components(docs).collect()} == root


def test_shingles_are_made_of_small_slices(monkeypatch):
    """A worker holds the shingles of a megabyte of text at a time."""
    sets, sizes = jaccard_tiles._sets, []

    def counted(column, width):
        sizes.append(sum(len(t.as_py()) for t in column))
        return sets(column, width)

    monkeypatch.setattr(jaccard_tiles, "_sets", counted)
    text = " ".join(f"w{k}" for k in range(20_000))
    batch = pa.record_batch({"doc_id": np.arange(30), "text": [text] * 30})
    assert sum(b.num_rows for b in jaccard_tiles._lowest(iter([batch]), 5)) > 0
    assert sum(b.num_rows for b in jaccard_tiles._digests(iter([batch]), 5)) == 30
    assert sum(sizes) == 60 * len(text) and max(sizes) <= 1 << 20


def test_a_worker_keeps_an_encoder_only_while_it_encodes():
    """Steps of another kind find no memory of chunks beside them."""
    from emberfield.llm import textbatch

    batch = pa.record_batch({"doc_id": [1, 2], "text": ["a b c", "d"]})
    assert sum(b.num_rows for b in best_two_fit._cut(iter([batch]), BYTE, 2, 1024, False)) == 2
    own = Encoder.of(BYTE)
    assert sum(b.num_rows for b in best_two_fit._cut(iter([batch]), BYTE, 2, 1024, False)) == 2
    assert Encoder.of(BYTE) is own and own.memory.young
    assert sum(b.num_rows for b in jaccard_tiles._digests(iter([batch]), 5)) == 2
    assert not textbatch.KEPT and Encoder.of(BYTE) is not own


def test_operators_change_their_own_batch_size_only(spark):
    key = session._BATCH_BYTES
    spark.conf.unset(key)
    try:
        session.small_batches(spark, session.FINE_BYTES)
        assert int(spark.conf.get(key)) == session.FINE_BYTES
        session.small_batches(spark)
        assert int(spark.conf.get(key)) == session.BATCH_BYTES
        spark.conf.set(key, 3 << 20)
        session.small_batches(spark, session.FINE_BYTES)
        assert int(spark.conf.get(key)) == 3 << 20
    finally:
        spark.conf.unset(key)


def test_language_and_duplicates_send_no_rows_from_python(spark, monkeypatch):
    """Such rows have Python workers of their own, which stay beside those that serve the texts."""
    rows = [(i, text, lang) for i in range(20) for text, lang in ((f"the dog number {i}", "en"), (f"der hund nummer {i}", "de"))]
    docs = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "doc_id long, text string, lang string")
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    model = language_backoff.fit(docs, documents=1000)
    assert model["languages"] == ["de", "en"] and {"the", "der"} <= set(model["tables"][0][0])
    # No two texts share a shingle, so no sets are needed.
    got = jaccard_tiles.shingle_components(docs).collect()
    assert len(got) == 40 and all(r.component_id == r.doc_id for r in got)
