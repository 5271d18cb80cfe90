"""Each training-data operator against a plain version, and on nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnsearch.llm import ann, components, exact_dedup, html_text, lang_id, license_scan, minhash, mixing, packing, pii, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the quick brown fox jumps over the lazy dog while other animals watch it with great interest today"
DE = "der schnelle braune fuchs springt über den faulen hund während andere tiere ihm heute gerne zusehen"


def docs_of(spark, texts, schema=DOCS):
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}" if i % 5 else None, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns named like results."""
    rows = [
        (1, "same words here and there", "en", "a", 1, "x", True),
        (1, "same words here and there", "en", "a", 1, "x", True),
        (2, "same words here and there", None, None, None, None, None),
        (None, "another text without an id", "en", "b", 1, "x", None),
        (3, None, "en", "b", 1, "x", None),
        (4, "", "en", None, 1, "x", None),
        (5, " \n\t ", None, "c", 1, "x", None),
        (6, "word " * 60_000, "en", "c", 1, "x", None),
        (None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS + ", keep_id string, kept boolean")


def test_every_operator_takes_odd_rows_and_empty_tables(spark, odd):
    for table in (odd, odd.limit(0)):
        n = table.count()
        assert lang_id.predict(table, lang_id.fit(table)).count() == n
        assert minhash.near_duplicates(table).count() == n
        assert exact_dedup.with_groups(table).count() == n
        assert pii.digest(table).count() == n
        assert mixing.copy_numbers(table).count() == n
        assert license_scan.digest(table).count() == n
        pieces = rows_of(packing.pack(table))
        assert sum(p["piece"] == 0 for p in pieces) == n
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("lang").alias("url"), "kept")
    for table in (pages, pages.limit(0)):
        assert html_text.extract(table).count() == table.count()
        assert url_filter.filter_urls(table).count() == table.count()


@pytest.mark.parametrize("glob,yes,no", [
    ("*.org/**", ["a.org/", "b.a.org/x/y"], ["org/", "a.net/x.org/", "a.org"]),
    ("a?c/**x", ["abc/x", "a*c/yyx"], ["ac/x", "abc/xy"]),
    ("**", ["", "x/y"], []),
    ("é*/", ["é/", "éab/"], ["e/"]),
])
def test_automaton(glob, yes, no):
    many = [f"filler{i}/**" for i in range(20)]
    automaton = url_filter.Automaton.of([*many, glob, *many])
    found = automaton.matches([*yes, *no])[:, len(many)]
    assert found.tolist() == [True] * len(yes) + [False] * len(no)


def test_url_rules(spark):
    urls = {
        "http://WWW.Example.org/en/12?q": ("www.example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/fr#x": ("example.org", "/fr", "org/", "allow"),
        "x://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
        "x://com.net/de/": ("com.net", "/de/", None, "allow"),
        "x://cheap-pills.net/": ("cheap-pills.net", "/", None, "block"),
        "x://a.org": ("a.org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())


def test_language_held_out_and_rejection(spark):
    docs = docs_of(spark, [" ".join(np.random.default_rng(i).permutation((EN if i % 2 else DE).split())) for i in range(120)])
    model = lang_id.fit(docs.filter(~lang_id.held_out(F.col("doc_id"))))
    found = rows_of(lang_id.identify(docs))
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert held and all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") and not r["rejected"] for r in held)
    names, score, rejected = model.predict([None, "123 !", "Ελληνικά κείμενα γράφονται με άλλα γράμματα " * 5, EN])
    assert names[:2] == ["und", "und"] and score[:2].tolist() == [0, 0] and rejected.tolist() == [True, True, True, False]


def test_long_texts_count_every_gram(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcé ß1 "), n)) for n in (3, 64, 65, 66, 127, 128, 129, 500)]
    whole = lang_id.gram_counts(texts)
    monkeypatch.setattr(lang_id, "CHUNK", 64)
    assert (lang_id.gram_counts(texts) == whole).all()
    assert (lang_id.gram_counts(["ab"] * 3 + [texts[-1], None, "", texts[0]])[3] == whole[-1]).all()


def test_more_labels_than_can_be_learned(spark, monkeypatch):
    """The commonest labels are learned; rare ones of a dirty column teach nothing and stop nothing."""
    monkeypatch.setattr(lang_id, "MAX_LANGUAGES", 2)
    rows = [(i, EN if i % 2 else DE, ("en", "de")[i % 2 == 0]) for i in range(40)] + [(100 + i, EN, f"dirt{i}") for i in range(9)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == {"en", "de"}


def test_predictions_equal_a_plain_version(spark):
    """Counts by dictionaries, cosines by sums: the nearest centroid, its cosine and the distance bound decide."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lang_id.fit(docs.filter(~lang_id.held_out(F.col("doc_id"))))
    found = {r["doc_id"]: r for r in lang_id.identify(docs).collect()}

    def grams(text):
        points = [0, *[ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text], 0]
        out = collections.Counter()
        mask = (1 << 32) - 1
        mix = lambda h: (((h ^ h >> 15) * 0x2C1B3C6D) & mask) >> (32 - 13)
        for i, a in enumerate(points):
            b, c = (points[i + 1 :] + [0, 0])[:2]
            if a:
                out[mix((a * 0x9E3779B1 + 1) & mask)] += 1
            if i + 1 < len(points) and (a or b):
                out[mix((a * 0x85EBCA77 + b * 0x9E3779B1 + 2) & mask)] += 1
            if i + 2 < len(points) and b:
                out[mix((a * 0xC2B2AE3D + b * 0x85EBCA77 + c * 0x9E3779B1 + 3) & mask)] += 1
        return out

    some = docs.filter("length(text) < 3000").limit(40).collect()
    for row in some:
        counts = grams(row["text"])
        vector = {g: np.log1p(n) * float(model.idf[g]) for g, n in counts.items()}
        length = np.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * float(c[g]) for g, v in vector.items()) / length for c in model.centroids] if counts else []
        got = found[row["doc_id"]]
        if not counts:
            assert (got["lang_pred"], got["score"]) == ("und", 0)
            continue
        best = int(np.argmax(cosines))
        assert got["lang_pred"] == model.languages[best] and abs(got["score"] - cosines[best]) < 1e-4
        size = min(int(np.log2(sum(counts.values()))), lang_id.BUCKETS - 1)
        if abs(1 - cosines[best] - model.radius[best, size]) > 1e-3:
            assert got["rejected"] == (1 - cosines[best] > model.radius[best, size])


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Task functions travel by value: with the package on the driver's path alone, language ID and packing run."""
    import pathlib
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[2]
    script = f"""
import sys
sys.path.insert(0, {str(root)!r})
import __spark_entry__ as entry
from cairnsearch.session import build_session
spark = build_session("by-value", **{{"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path)!r},
                                     "spark.sql.shuffle.partitions": "2"}})
found = entry.queries()
for name in ("op2_language_id", "op3_best_fit_packing"):
    print(name, found[name](spark, "/root/testdata/sf0.001").count() >= 200)
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    path = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and not p.startswith(str(root))]
    if path:
        env["PYTHONPATH"] = ":".join(path)
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "op2_language_id True" in out.stdout and "op3_best_fit_packing True" in out.stdout, out.stderr[-2000:]


def test_language_left_out_of_training_is_rejected_and_clean_texts_stay(spark):
    french = (
        "la rivière coule lentement vers la mer pendant que les enfants jouent sur le sable et leurs parents regardent les bateaux "
        "qui rentrent au port avec beaucoup de poissons pour le marché du lendemain matin"
    ).split()
    letters = list("αβγδεζηθικλμνξοπρστυφχψω")

    def text(i):
        rng = np.random.default_rng(i)
        return " ".join(rng.permutation(EN.split()) if i % 2 else ["".join(rng.choice(letters, 6)) for _ in range(16)])

    # the texts labelled de differ widely, which must not widen what counts as en
    model = lang_id.fit(docs_of(spark, [text(i) for i in range(120)]))
    assert not model.predict([text(1000 + i) for i in range(40)])[2].any()
    assert model.predict([" ".join(np.random.default_rng(i).permutation(french)) for i in range(10)])[2].all()


def test_tokens_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    plain.encode_special_tokens = True
    encode = packing.encoder(packing.tokenizer_path())
    for text in ["", " ", "a  b   c", " \n x", "l'été 12,5 d'un", "<|endoftext|> don't", "日本語 ß \x1c", EN + "\n\n" + DE]:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [10, 4095, 4096, 5000, 10**6, 2 * 10**6])
def test_long_gaps_are_tokenised_as_by_the_tokenizers_library(run):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.encoder(packing.tokenizer_path(), added=True)
    for gap in (" " * run, "\n" * run, " \n" * (run // 2), "\t\u3000" * (run // 2)):
        for text in (gap, gap + "x", "x" + gap, f"a{gap}<|endoftext|>{gap}b{gap}.", f"\x1c{gap}\x1c"):
            if run <= 5000 or text.count(gap) == 1 and gap[0] != gap[-1] or text in (gap, gap + "x"):
                assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_packed_as_by_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["<|endoftext|> don't", " a <|endoftext|><|endoftext|>  x\n<|endoftext|>", "<|endoftext| no", EN]
    pieces = rows_of(packing.pack(docs_of(spark, texts), length=256, with_ids=True))
    assert {p["doc_id"]: p["ids"] for p in pieces} == {i: plain.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}


def test_packing(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(EN.split(), int(n))) for n in rng.integers(1, 900, 200)] + [None, "", "word " * 5000]
    pieces = rows_of(packing.pack(docs_of(spark, texts), length=256, with_ids=True))
    encode = packing.encoder(packing.tokenizer_path())
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for i, text in enumerate(texts):
        mine = sorted(by_doc[i], key=lambda p: p["piece"])
        whole = np.frombuffer(encode(text), "<u4").tolist() + [2]
        assert [t for p in mine for t in p["ids"]] == whole
        assert all(p["length"] == 256 for p in mine[1:])
        assert all(zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] for p in mine)
    for mine in by_sequence.values():
        place = 0
        for p in sorted(mine, key=lambda p: p["offset"]):
            assert p["offset"] == place
            place += p["length"]
        assert place <= 256
    total = sum(p["length"] for p in pieces)
    assert len(by_sequence) <= 1.02 * total / 256 + 1


def test_plan_is_as_good_as_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for _ in range(5):
        counts = collections.Counter(rng.integers(1, 1025, 3000).tolist())
        best_fit = packing.Plan(1024)
        for size in sorted(counts, reverse=True):
            best_fit.best_fit(size, counts[size])
        made = packing.plan(counts, 1024)
        assert made.used == counts
        assert made.sequences <= best_fit.sequences * 1.003


def plain_components(texts, words, percent=80):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(words, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary, 120).tolist() for _ in range(3)]
    texts = {}
    for i in range(150):
        words = list(base[i % 3]) if i % 5 else rng.choice(vocabulary, 60).tolist()
        for j in rng.integers(0, len(words), int(rng.integers(0, 14))):
            words[j] = str(rng.choice(vocabulary))
        texts[i] = " ".join(words)
    texts |= {200: "ONE", 201: "one", 202: "", 203: None, 204: " \n", 205: "é", 206: "É"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for words in (2, 5):
        got = {r["doc_id"]: r for r in rows_of(minhash.near_duplicates(docs, words=words))}
        want = plain_components(texts, words)
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:2000], rng.integers(0, 1 << 63, 1000).astype(np.uint64)]))
    same = (minhash.circulant_signature(a, 512) == minhash.circulant_signature(b, 512)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.08


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["id"]: r["component"] for r in rows_of(components.connected(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_nearest_finds_true_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[1] = x[2] = x[3] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in rows_of(ann.search_fiftieths(table)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    assert len(got) == 60
    for q, found in got.items():
        found.sort()
        score = unit @ unit[q]
        score[q] = -2
        best = np.lexsort((np.arange(len(x)), -np.round(score, 12)))[:5]
        hits += len(set(best) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(score[v] - s) < 1e-12 for _, v, s in found)
    assert hits >= 0.9 * 300
    assert [v for _, v, _ in got[50][:3]] == [1, 2, 3]


def test_few_vectors_give_all_candidates(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in ann.search_fiftieths(table).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search_fiftieths(table.limit(0)).count() == 0


def test_equal_vectors_ask_once_and_leave_out_themselves(spark):
    """Two thirds of the vectors are copies; rows repeat ids; every row asks, and gets what brute force gives."""
    rng = np.random.default_rng(12)
    vectors = {i: rng.normal(size=6) if i % 3 == 0 else np.arange(1.0, 7.0) for i in range(90)}
    rows = [(i, v.tolist(), 5, "x") for i, v in vectors.items()] + [(4, np.arange(1.0, 7.0).tolist(), 5, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string").repartition(3)
    found = collections.defaultdict(list)
    for r in sorted(rows_of(ann.nearest(table, table)), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    shared = 0
    for i, q in vectors.items():
        scores = {j: float(q @ v / np.sqrt((q @ q) * (v @ v))) for j, v in vectors.items() if j != i}
        want = sorted(scores, key=lambda j: (-round(scores[j], 12), j))[:5]
        got = [j for j, _ in found[i]]
        assert len(set(got)) == 5 and (i % 3 == 0 or got == want)
        assert all(abs(s - scores[j]) < 1e-12 for j, s in found[i])
        shared += len(set(got) & set(want))
    assert shared >= 0.9 * 5 * len(vectors)


def test_exact_groups(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "odd"))
    stored = spark.read.parquet(str(tmp_path / "odd"))
    found = rows_of(exact_dedup.with_groups(stored))
    same = [r for r in found if r["text"] == "same words here and there"]
    assert [r["group_size"] for r in same] == [3, 3, 3] and {r["keep_id"] for r in same} == {2}
    assert [r["doc_id"] for r in same if r["kept"]] == [2]
    empty = [r for r in found if not r["text"]]
    assert {r["group_size"] for r in empty} == {3} and [r["doc_id"] for r in empty if r["kept"]] == [4]
    assert {r["text_sha256"] for r in empty} == {hashlib.sha256(b"").hexdigest()}
    left = exact_dedup.deduplicate(stored)
    assert left.columns == stored.columns and left.count() == 5


def test_base_spans():
    text = "a.b@c-d.e.f, x@y z@@q.r 1.2.3.4 1.2.3.256 001.02.3.4.5 4111 1111 1111 1111 4111111111111112 +49 (30) 123-4567 +1 23"
    got = [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)]
    # the digits of both cards are one match, of 32 digits, which is dropped
    assert got == [
        ("email", "a.b@c-d.e.f"),
        ("ip", "1.2.3.4"),
        ("ip", "001.02.3.4"),
        ("phone", "+49 (30) 123-4567"),
    ]
    assert [(pii.KINDS[k], "4111 1111-1111 1111 x"[s:e]) for k, s, e in pii.base_spans("4111 1111-1111 1111 x")] == [("card", "4111 1111-1111 1111")]
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    rng = np.random.default_rng(6)
    for _ in range(3000):
        t = "".join(rng.choice(list("ab.@_-% "), 30))
        assert list(pii._emails(t)) == [m.span() for m in plain.finditer(t)]


def plain_spans(text):
    """The base spans by plain patterns and checks."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_all_kinds_equal_plain_patterns(spark):
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("ab.@+1234567890-() 4"), 60)) for _ in range(3000)]
    for text in texts:
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)] == plain_spans(text)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r["doc_id"]: r for r in pii.digest(docs).collect()}
    for r in docs.collect():
        spans = plain_spans(r["text"])
        shown = ",".join(f"{kind}:{s}:{e}" for kind, s, e in spans)
        got = found[r["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [got[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in spans) for k in pii.KINDS]
        assert got["spans"].startswith(shown)


def test_disclosing_terms_are_marked_only_near_their_entity(spark):
    texts = [f"ask zorblatt at z.b@mail.org for item {chr(97 + i) * 5}" for i in range(8)]
    texts += [f"plain words {chr(97 + i % 26) * 4} without ask" for i in range(200)]
    found = {r["doc_id"]: r for r in rows_of(pii.find_personal_data(docs_of(spark, texts)))}
    for i in range(8):
        marked = {texts[i][t["start"] : t["end"]] for t in found[i]["terms"]}
        assert "zorblatt" in marked and found[i]["spans"]
    assert not any(found[i]["terms"] or found[i]["spans"] for i in range(8, len(texts)))
    clean = {r["doc_id"]: r["text"] for r in rows_of(pii.sanitise(docs_of(spark, texts)))}
    assert "zorblatt" not in clean[0] and "[email]" in clean[0] and clean[100] == texts[100]


def test_entities_of_the_same_texts_are_paired_once(spark, monkeypatch):
    """Two texts that share many addresses and many words make a pair per word, and every disclosure equals a plain one."""
    letters = "abcdefghij"
    rare = [f"w{a}{b}q" for a in letters for b in letters[:4]]
    lists = [" ".join([f"{w}@x.org" for w in rare[:30]] + rare + [f"only{letters[i] * 3}", f"me{i}@y.org"]) for i in range(2)]
    texts = [*lists, *[f"plain {letters[i % 10]}{letters[i // 10 % 10]}z words" for i in range(300)]]
    stored, kept = {}, pii.store
    monkeypatch.setattr(pii, "store", lambda df, name: stored.setdefault(name, kept(df, name)))
    docs = docs_of(spark, texts)
    found = pii.store(pii.scanned(docs, "doc_id", "text"), "scan")
    got = {}
    for r in pii.disclosing_terms(found, docs, "doc_id", "text", generalise=-9.0).collect():
        got[r["copy"], r["term"]] = r["disclosure"]
    assert stored["pii-pairs"].count() <= 2 * 2 * (len(rare) + 5)
    copies = {r["id"]: r["copy"] for r in found.collect()}
    total = float(len(set(texts)))
    words = [set(re.findall(r"[^\W\d_]+", t.lower())) for t in texts]
    for i, text in enumerate(lists):
        own = set(re.findall(r"\S+@\S+", text))
        for term in ("only" + letters[i] * 3, rare[35]):
            n_term = sum(term in w for w in words)
            best = max(
                1 + np.log((n + pii.SMOOTHING * c / total) / (n_term + pii.SMOOTHING)) / -np.log(c / total)
                for c, n in ((sum(e in t.split() for t in lists), sum(e in t.split() and term in w for t, w in zip(texts, words))) for e in own)
            )
            assert abs(got[copies[i], term] - best) < 1e-9


def test_terms_disclose_entities_of_one_document_wherever_they_stand(spark):
    common = [" ".join(np.random.default_rng(i).permutation(EN.split())) for i in range(300)]
    texts = [f"Zorblatt wrote. {c}" for c in common[:1]]
    texts[0] += f". Mail z.b@mail.org, {common[1]} and 王伟 said. {common[2]} zorblatt again"
    texts += [texts[0]] * 5 + ["four eyes x@y.zz " + c for c in common[3:6]] + common[6:]
    found = {r["doc_id"]: r for r in rows_of(pii.find_personal_data(docs_of(spark, texts)))}
    for i in range(6):
        marked = [texts[i][t["start"] : t["end"]] for t in found[i]["terms"]]
        assert marked.count("Zorblatt") == marked.count("zorblatt") == marked.count("王伟") == 1
        assert not {w for w in marked if w.lower() in EN.lower().split()}
    assert not any(found[i]["terms"] for i in range(9, len(texts)))
    alone = rows_of(pii.find_personal_data(docs_of(spark, ["only text a@b.cc here"])))
    assert alone[0]["spans"] and alone[0]["terms"] == []


def test_html_article(spark):
    html = (
        "<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body><nav>menu</nav><div class='ad'>buy</div>"
        "<article><h1>Head &amp; more</h1><p><b>One\n two<br>three<p>Four &copy;</p><div class='comments'>said</div></article>"
        "<footer>foot</footer></body>"
    )
    pages = spark.createDataFrame([(1, "x://a/", html), (2, None, None), (3, "x://a/", "<p>cut <a hre")], "page_id int, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.digest(pages).collect()}
    want = "Head & more\n\nOne two three\n\nFour ©"
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("cut", 3)}


def test_names_of_wrappers_do_not_drop_the_article():
    body = "<p>one two three four five six seven</p>"
    pages = {
        f"<div class='layout has-sidebar'><main>{body}</main></div>": True,
        f"<div class='no-sidebar'>{body}</div>": True,
        f"<div class='post comments-open'>{body}</div>": True,
        f"<div id='search-results'>{body}</div>": True,
        f"<form><div>{body}</div></form><nav>{body * 3}</nav>": True,
        f"<div class='search'><article>{body}</article></div>": True,
        f"<aside><main>{body}</main></aside>": True,
        f"<div class='sidebar'>{body}</div><article><p>short</p></article>": False,
        f"<article>{body}<div class='comments'><article>said</article></div></article>": True,
        f"<nav>{body}</nav><p>short</p>": False,
    }
    for html, kept in pages.items():
        texts = [text for _, text, *_ in html_text.page_blocks(html)[0]]
        assert texts == (["one two three four five six seven"] if kept else ["short"]), html


def test_site_style_tree_removes_what_a_site_repeats(spark):
    rows = [(i, "http://h.com/", f"<div><p>Welcome to our site</p></div><section><p>story {i}</p></section>") for i in range(12)]
    rows += [(99, "http://other.com/", "<div><p>Welcome to our site</p></div>")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {i: f"story {i}" for i in range(12)} | {99: "Welcome to our site"}


def test_style_tree_covers_articles_and_counts_copies_once(spark):
    def page(i, inner):
        return f"<body class='post-{i} by-{chr(97 + i)}'>{inner}</body>"

    story = [f"<article><p id='p{i}'>story {i}</p><div id='x{i}'><span>Get our app today</span></div></article>" for i in range(12)]
    rows = [(i, "http://a.com/", page(i, s)) for i, s in enumerate(story)]
    # the body beside an article that is a teaser, and copies at a path of their own
    rows += [(100, "http://b.com/", "<div><p>The whole body</p></div><article><p>A teaser</p></article>")]
    rows += [(200 + i, "http://c.com/", "<section><p>The copied text</p></section>") for i in range(8)]
    # a hot path: as many copies as other pages
    rows += [(300 + i, "http://d.com/", f"<section><p>text {min(i, 20)}</p></section>") for i in range(41)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    want = {i: f"story {i}" for i in range(12)} | {100: "The whole body\n\nA teaser"} | {200 + i: "The copied text" for i in range(8)}
    assert got == want | {300 + i: f"text {min(i, 20)}" for i in range(41)}


def test_style_tree_equals_a_plain_one(spark):
    """Importance of every block by dictionaries: entropy of styles, spread of texts over different pages, on both paths."""
    rng = np.random.default_rng(9)
    rows = []
    for row in range(120):
        site, page = f"host{row % 3}", int(rng.integers(0, 40))
        own = np.random.default_rng(page)  # equal pages have equal blocks
        for place in range(6):
            path, plain = int(own.integers(0, 4)), int(own.integers(10, 12))
            text = ("menu", "legal", f"text {page} {place}", f"teaser {page % 5}")[int(own.integers(0, 4))]
            rows.append((row, page, site, place, path, int(own.integers(0, 3)), plain, int(own.integers(0, 2)), text, bool(own.integers(0, 2))))
    schema = "row long, page long, site string, place int, path long, style long, plain long, plain_style long, text string, inside boolean"
    args = (5, 0.45, 0.9, 0.2)
    found = {(r["row"], r["place"]) for r in html_text.unimportant(spark.createDataFrame(rows, schema), *args).collect()}
    pages, styles, texts = (collections.defaultdict(set) for _ in range(3))
    for _, page, site, _, path, style, plain, plain_style, text, inside in rows:
        for at, look in {(path, style), (plain, plain_style)}:
            pages[site, at].add(page)
            styles[site, at, look].add(page)
            texts[site, at, text, inside].add(page)

    def low(site, at, text, inside):
        m = len(pages[site, at])
        if m < 5:
            return False
        shares = [len(p) / m for (s, a, _), p in styles.items() if (s, a) == (site, at)]
        looks = -sum(x * np.log(x) for x in shares) / np.log(m)
        content = 1 - np.log(len(texts[site, at, text, inside])) / np.log(m)
        return 0.1 * looks + 0.9 * content + 0.2 * inside < 0.45

    want = {
        (row, place)
        for row, _, site, place, path, _, plain, _, text, inside in rows
        if low(site, path, text, inside) or low(site, plain, text, inside)
    }
    assert found == want and 0 < len(want) < len(rows)


def test_mix_reaches_targets(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "w " * int(rng.integers(1, 200)), "abcd"[int(i**0.5) % 4] if i % 9 else None) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rows_of(mixing.taken_words(docs))
    assert got == rows_of(mixing.taken_words(docs)) or sorted(map(str, got)) == sorted(map(str, rows_of(mixing.taken_words(docs))))
    size, taken, target = collections.Counter(), collections.Counter(), {}
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
    weights = dict(zip(sorted(k for k in size if k) + [None], [5, 2, 1, 5, 2]))
    left, want = set(size), {}
    while left:
        share = (sum(size.values()) - sum(want.values())) / sum(weights[s] for s in left)
        over = {s for s in left if share * weights[s] > 3 * size[s]}
        want |= {s: 3.0 * size[s] for s in over} or {s: share * weights[s] for s in left}
        left = left - over if over else set()
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] for s in want)
    assert all(abs(taken[s] - want[s]) <= 200 for s in want)
    assert mixing.mix(docs).count() == sum(r["copies"] for r in rows_of(mixing.copy_numbers(docs)))


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_licences(spark):
    texts = [
        "x\nLicensed under the Apache License, Version 2.0.\ny",
        "the MIT license and the mit-license, GENERAL public license",
        "Licensed under CC BY-NC 4.0.",
        "permission is given; licensed cc version apache",
        "mit licenses",
        None,
    ] + [f"plain words {i} of the text" for i in range(60)]
    got = {r["doc_id"]: r for r in rows_of(license_scan.digest(docs_of(spark, texts)))}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["labels"], got[0]["score"]) == (1, 4, "apache,apache-2.0", 1.0)
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 1, 7, "gpl,mit")
    assert got[2]["labels"] == "cc-by-nc-4.0" and got[2]["n_base"] == 0 and got[2]["score"] >= 0.75
    assert [got[i]["labels"] for i in (3, 4, 5, 20)] == ["", "", "", ""]
    assert got[5]["n_words"] == 0 and got[5]["first_word"] is None


def test_licence_texts_need_their_words_in_place(spark):
    """Whole notices within other text are found, shuffled ones and ones without the key phrase are not."""
    notices = {label: text for label, text, _ in license_scan.TEMPLATES if len(text.split()) > 30}
    rng = np.random.default_rng(3)
    texts = [f"Before: {t.title()}, after {i}" for i, t in enumerate(notices.values())]
    texts += [" ".join(rng.permutation(t.split())) for t in notices.values()]
    texts += [" ".join(t.split()[len(t.split()) // 2 :]) for t in notices.values()]
    texts += [f"plain words {i} of the text" for i in range(100)]
    got = {r["doc_id"]: set(r["labels"]) for r in rows_of(license_scan.scan(docs_of(spark, texts)))}
    for i, label in enumerate(notices):
        assert label in got[i]
        assert not got[len(notices) + i] & set(notices) and not got[2 * len(notices) + i] & set(notices)
    assert not any(got[i] for i in range(3 * len(notices), len(texts)))


def test_licence_scan_equals_a_plain_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: r for r in license_scan.digest(docs).collect()}
    words = {i: plain_words(t) for i, t in texts.items()}
    vocabulary = {w for _, t, _ in license_scan.TEMPLATES for w in t.split()}
    idf = {w: np.log((1 + len(words)) / (1 + sum(w in x for x in words.values()))) for w in vocabulary}
    indexed = {label: sorted(set(t.split()), key=lambda w: (-idf[w], w))[: license_scan.INDEXED] for label, t, _ in license_scan.TEMPLATES}
    every = {w for ws in indexed.values() for w in ws}
    for i, own in words.items():
        base, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            parts = phrase.split()
            at = [j for j in range(len(own)) if own[j : j + len(parts)] == parts]
            base += at
            labels |= {label} if at else set()
        asked = sorted(every & set(own), key=lambda w: (-idf[w], w))[: license_scan.LOOKED_UP]
        own_labels, line = set(labels), f" {' '.join(own)} "
        for label, template, key in license_scan.TEMPLATES:
            if f" {key} " not in line:
                continue
            parts = template.split()
            begins = {j - k for j, w in enumerate(own) if w in asked for k, p in enumerate(parts) if p == w and w in indexed[label]}
            weight = {w: idf[w] / parts.count(w) for w in indexed[label]}
            shares = [
                sum(weight[p] for k, p in enumerate(parts) if p in weight and 0 <= b + k < len(own) and own[b + k] == p)
                / sum(idf[w] for w in indexed[label])
                for b in begins
            ]
            if shares and max(shares) >= license_scan.ALIGNED:
                own_labels.add(label)
        r = found[i]
        assert (r["n_words"], r["n_base"]) == (len(own), len(base))
        assert (r["first_word"], r["last_word"]) == ((min(base), max(base)) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted(labels)) and r["labels"] == ",".join(sorted(own_labels))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts = [f"{EN} number {i} " + " ".join(f"u{i}x{j}" for j in range(30)) for i in range(40)]
    texts += [texts[0], texts[1] + " end", "12345", None]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r["doc_id"] for r in docs.collect()})
    assert left[0] == set(range(42))
    assert left[1] == set(range(1, 42))
    assert left[2] == set(range(1, 41))
    assert left[3] <= left[2]
    assert {r["doc_id"] for r in rows_of(corpus_pipeline.run(spark, str(tmp_path)))} == left[3]


def test_bands_of_near_copies_meet_their_documents_once(spark, monkeypatch):
    """Joins by id in near-duplicate detection make a row per document, however many bands a group of near copies shares."""
    import random

    from cairnsearch.llm import minhash

    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        text = list(base)
        for at in rng.sample(range(60), 9):
            text[at] = f"x{i}y{at}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, kind, kept = [], type(docs), type(docs).join

    def counting(self, other, on=None, how=None):
        joined = kept(self, other, on, how)
        if isinstance(on, str) and on == "id" and how == "left_semi":
            made.append(joined.count())
        return joined

    monkeypatch.setattr(kind, "join", counting)
    found = minhash.near_duplicates(docs, words=2)
    assert found.count() == 40 and made and max(made) <= 40
