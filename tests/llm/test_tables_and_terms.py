"""Collocations, the path-copying manifest and disclosure control against brute force and edge rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from emberfield.llm import collocations, disclosure, path_manifest, queries

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- collocations ------------------------------------------------------------------------------------------------


def _phrases(docs, least, top):
    """All contract columns by plain counting."""
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_TO_Z)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in found.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def _corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "the", "THE", "a_b"]
    out = []
    for i in range(n):
        own = [words[min(int(rng.expovariate(0.15)), len(words) - 1)] for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            own[rng.randrange(len(own) + 1) : 0] = ["new", "york", "city"] if i % 2 else ["new", "york"]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "  "]) for w in own)
        out.append((text, rng.choice(["en", "de", None, "und"])))
    return [*out, (None, "en"), ("", "fr"), (" ,.", "fr"), ("lonely", "it")]


def _mined(spark, docs, **how):
    rows = [(i, t, lang, "clash") for i, (t, lang) in enumerate(docs)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string").repartition(5)
    return sorted(map(tuple, collocations.collocations(table, **how).collect()))


def test_collocations_equal_plain_counts(spark):
    docs = _corpus(4, 1200)
    want = _phrases(docs, 10, 2000)
    assert len(want) > 20 and any(p[2].count(" ") == 2 for p in want)
    assert _mined(spark, docs) == want


def test_collocations_settle_in_rounds_with_ties(spark, monkeypatch):
    """Few wanted phrases: levels, bounds and the dropping of inner phrases decide over several rounds."""
    monkeypatch.setattr(collocations, "_DEEPER", 2)
    docs = _corpus(9, 150)
    # Whole phrases whose inner pairs all go, so that the first level holds fewer than wanted; equal scores among them.
    docs += [(f"x{i} y{i} z{i}", "en") for i in range(9) for _ in range(12)]
    for top in (1, 4, 12):
        assert _mined(spark, docs, top=top) == _phrases(docs, 10, top)


def test_collocations_of_nothing(spark):
    assert _mined(spark, []) == [] and _mined(spark, [(None, None), ("", "en"), ("one two", "en")]) == []


def test_a_long_text_counts_whole(spark):
    text = "red fox " * 300_000
    (row,) = _mined(spark, [(text, "en")], top=1)
    assert row == _phrases([(text, "en")], 10, 1)[0]


def test_score_is_exact_beyond_64_bits(spark):
    a, l, r = 7_999_999_999_999, 8_000_000_000_003, 9_000_000_000_001
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(collocations._score(*map(F.col, "alr"))).first()[0]
    assert got == 10**6 * a * a // (l * r)


# -- manifest ----------------------------------------------------------------------------------------------------


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(*values):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_h("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def _around(levels, place):
    out = []
    for nodes in levels[:-1]:
        out.append((nodes[place - 1] if place % 2 else "", nodes[place + 1] if place % 2 == 0 and place + 1 < len(nodes) else ""))
        place //= 2
    return out


def _manifest(rows):
    """All contract columns from whole trees in memory."""
    own = collections.defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        own[lang].append((doc_id is not None, doc_id or 0, _leaf(doc_id, source, lang, n, text), (doc_id, text, lang, source, n)))
    langs = sorted(own, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: _tree([r[2] for r in sorted(own[lang], key=lambda r: r[:3])]) for lang in langs}
    top = _tree([trees[lang][-1][0] for lang in langs])
    out = []
    for at, lang in enumerate(langs):
        for place, row in enumerate(sorted(own[lang], key=lambda r: r[:3])):
            doc_id, text, _, source, n = row[3]
            hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
            folded = _leaf(doc_id, source, lang, n + 1, text) if hit else row[2]
            around = _around(trees[lang], place) + _around(top, at)
            for left, right in around:
                folded = _h(left + folded + right)
            proof = _h("".join(a + b for a, b in around))
            out.append((doc_id, row[2], trees[lang][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def _manifest_of(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, hash string, tree string, at int"
    folder = str(tmp_path)
    spark.createDataFrame([(*r, "k", "h", "t", 3) for r in rows], schema).repartition(3).write.mode("overwrite").parquet(
        f"{folder}/documents.parquet"
    )
    return sorted(map(tuple, queries.op12_path_copying_manifest(spark, folder).collect()), key=repr)


def test_manifest_equals_whole_trees(spark, tmp_path, monkeypatch):
    """Blocks of four leaves, so that versions go on through several bands."""
    for name, value in (("LEVELS", 2), ("BLOCK", 4)):
        monkeypatch.setattr(path_manifest, name, value)
    rng = random.Random(2)
    langs = ["en"] * 6 + ["de", "", None, "é"]
    rows = [(i, f"tëxt {i}", rng.choice(langs), f"src{i % 3}", i * 5) for i in rng.sample(range(-400, 4000), 130)]
    rows += [(None, "no id", "en", None, None), (None, None, None, "s", 1), (7, "same id", "en", "s", None), (7, "same id", "en", "s", 2**63 - 1)]
    rows += [(11, "copy", "de", "s", 4)] * 9 + [(2**62 + 1, "x" * 2_000_000, "en", "s", 1)]
    got = _manifest_of(spark, tmp_path, rows)
    assert got == _manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    rows = [(5, "only", "en", "s", 3)]
    assert _manifest_of(spark, tmp_path / "one", rows) == _manifest(rows)
    assert _manifest_of(spark, tmp_path / "none", []) == []


def test_versions_copy_only_the_ancestors(spark):
    """A version holds the changed leaf, one node per level, and nothing else; the block's nodes stay as they were."""
    block = path_manifest.Block([_h(str(i)) for i in range(13)], 4)
    before = [list(level) for level in block.levels]
    for place in range(13):
        nodes = path_manifest.copied(_h("changed"), block.path(place))
        assert len(nodes) == 5 and nodes[-1] != block.top
        assert path_manifest.copied(block.levels[0][place], block.path(place))[-1] == block.top
    assert block.levels == before


# -- disclosure --------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _base(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and _luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def _spans(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, kind string, entities int")
    rows = disclosure.digests(disclosure.private_spans(docs.repartition(4), "doc_id"), "doc_id").collect()
    return {r.doc_id: r for r in rows}


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(5)
    atoms = ["@", "a", "b.c", "x_y", "1", "22", "255", ".", "-", " ", "+", "(", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4",
             "300.1.2.3", "a@b.co", "_", "é", "😀", "+1 (555) 555-1234", "00", "5555-5555-5555-4444", "\n"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(40))) for _ in range(1500)] + [None, "", "a@b.c_x@y.z", "1.2.3.4.5.6.7.8"]
    got = _spans(spark, texts)
    for i, text in enumerate(texts):
        want = _base(text)
        assert got[i].base_sha256 == _h(",".join(want)), text
        assert [s for s in got[i].spans.split(",") if s and s.split(":")[0] in PLAIN] == want
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in want) for k in PLAIN]


def test_long_runs_take_time_in_proportion(spark):
    texts = ["1" * 300_000, "a" * 300_000 + "@", "1 " * 150_000, "a@b.c " * 5000, "+1 " + " " * 200_000, "1.1.1." * 50_000, "é" * 100_000 + " x@y.zz"]
    got = _spans(spark, texts)
    assert [got[i].n_email for i in range(7)] == [0, 0, 0, 5000, 0, 0, 1] and got[5].n_ip == 37_500


def test_terms_that_disclose_are_generalised_or_removed(spark):
    """A name seen only beside one address goes; a common word stays; documents without the address stay as they are."""
    filler = [f"some ordinary words about item{chr(97 + i % 26)} and the weather" for i in range(400)]
    told = [f"note {'abcdef'[i]}: Quillon writes to jo@x.org about the weather" for i in range(6)]
    # Quilt and quilting share the stem of the name, so its generalised form no longer tells.
    others = ["a quilt", "quilting is slow", "quills", "quiet"] * 40
    texts = [*filler, *told, *others, "Quillon alone", "write to jo@x.org", None, ""]
    got = _spans(spark, texts)
    at = len(filler)
    name = told[0].index("Quillon")
    assert f"general:{name}:{name + 7}" in got[at].spans.split(",")
    assert not any("weather" == told[0][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[at].spans.split(",")) if k not in PLAIN)
    for i in [*range(at), *range(at + 6, at + 6 + len(others) + 1), len(texts) - 2, len(texts) - 1]:
        assert got[i].spans == ""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs, "doc_id").collect()}
    assert "Quillon" not in clean[at] and "qui*" in clean[at] and "<EMAIL>" in clean[at] and clean[at].endswith("the weather")
    assert clean[0] == texts[0] and clean[len(texts) - 4] == "Quillon alone" and clean[len(texts) - 2] == "" == clean[len(texts) - 1]


def test_without_a_common_form_a_term_goes(spark):
    filler = ["some ordinary words about the weather"] * 300
    told = [f"note {'abcdef'[i]} from Zyxwor jo@x.org" for i in range(6)]
    got = _spans(spark, [*filler, *told])
    place = told[0].index("Zyxwor")
    assert f"remove:{place}:{place + 6}" in got[300].spans.split(",")


def test_copies_of_one_context_prove_nothing(spark):
    got = _spans(spark, ["some ordinary words"] * 200 + ["note from Zyxwor jo@x.org"] * 20)
    assert got[200].spans == "email:17:25"


def test_terms_far_from_the_entity_disclose_it_too(spark):
    """The whole document counts, on both sides and beyond other addresses; words inside addresses prove nothing free."""
    filler = ["some ordinary words about the weather, " * 12] * 300
    told = [f"Zyxwor {'on and on ' * 30}note {'abcdef'[i]} jo@x.org, al{i}@y.net {'and so on ' * 30}Vutqon ends" for i in range(6)]
    got = _spans(spark, [*filler, *told])
    for i in range(300, 306):
        text = told[i - 300]
        spans = got[i].spans.split(",")
        assert "remove:0:6" in spans and f"remove:{text.index('Vutqon')}:{text.index('Vutqon') + 6}" in spans
        assert sum(s.split(":")[0] == "email" for s in spans) == 2
    assert all(got[i].spans == "" for i in range(300))


def test_disclosure_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert disclosure.digests(disclosure.private_spans(empty, "doc_id"), "doc_id").collect() == []
