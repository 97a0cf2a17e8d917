import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearsay.llm import fingerprints, language, near_dedup, pii, toxicity
from hearsay.llm.components import components


# --- personal data ---

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) \
                    or kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return out


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_patterns_match_plain_regular_expressions():
    rnd = random.Random(4)
    pieces = ["a@b.c", "@", ".", "1", "12", "255", "256", "+1", " ", "-", "(", "4111 1111 1111 1111", "x", "1.2.3.4", "é", "a.b", "555"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(text) == _plain_spans(text), text


def test_pii_query_on_odd_rows(odd_docs, odd_rows):
    rows = pii.find(odd_docs, pii.fit(odd_docs)).collect()
    expected = collections.Counter()
    for r in odd_rows:
        base = _plain_spans(r[1])
        expected[r[0], hashlib.sha256(pii.joined(base).encode()).hexdigest(), sum(s[0] == "phone" for s in base)] += 1
    assert collections.Counter((r.doc_id, r.base_sha256, r.n_phone) for r in rows) == expected
    texts = {r[0]: r[1] for r in odd_rows}
    for r in rows:
        assert set(pii.joined(_plain_spans(texts[r.doc_id])).split(",")) <= set(r.spans.split(","))


def test_labels_travel_along_skip_edges():
    model = {"unary": np.zeros((pii.N_FEATURES, 5)), "chain": np.zeros((5, 5)), "skip": [3.0, 5.0]}
    model["unary"][0, 0] = 1.0  # nothing is likeliest without evidence
    text = "call +1 (784) 555-9263 now, as said 555-9263 is it, not 123-4567"
    base, more = pii.search([text], model)[0]
    assert [s[0] for s in base] == ["phone"]
    assert [(k, text[a:b]) for k, a, b in more] == [("phone", "555-9263")]


def test_labels_reach_all_of_many_occurrences():
    model = {"unary": np.zeros((pii.N_FEATURES, 5)), "chain": np.zeros((5, 5)), "skip": [3.0, 5.0]}
    model["unary"][0, 0] = 1.0
    for before, after in ((0, 30), (30, 0), (15, 15)):
        text = "as said 555-9263 is it " * before + "call +1 (784) 555-9263 now " + "as said 555-9263 is it " * after
        base, more = pii.search([text], model)[0]
        assert len(base) == 1 and [(k, text[a:b]) for k, a, b in more] == [("phone", "555-9263")] * 30


def test_message_passing_goes_on_until_settled():
    model = {"unary": np.zeros((pii.N_FEATURES, 5)), "chain": np.eye(5) * 4.0, "skip": [1.0, 1.0]}
    field = pii.Field()
    field.add(0, "a@b.co " + " ".join(f"{i}" for i in range(10, 60)), [("email", 0, 6)])
    field.add(1, "1 22", [])
    assert np.allclose(pii.infer(field, model), pii.infer(field, model, rounds=2_000), atol=1e-3)


def _brute_marginals(field, model):
    import itertools
    n = len(field.labels)
    x, total = field.matrix() @ model["unary"], np.zeros((n, 5))
    for labels in itertools.product(range(5), repeat=n):
        if any(y and y != l for y, l in zip(field.labels, labels)):
            continue
        z = sum(x[i, l] for i, l in enumerate(labels) if not field.labels[i])
        z += sum(model["chain"][labels[a], labels[b]] for a, b in field.chain)
        z += sum(model["skip"][k] for a, b, k in field.skip if labels[a] == labels[b])
        for i, l in enumerate(labels):
            total[i, l] += np.exp(z)
    return total / total.sum(1, keepdims=True)


def test_message_passing_is_exact_on_trees():
    rnd = np.random.default_rng(1)
    model = {"unary": rnd.normal(size=(pii.N_FEATURES, 5)), "chain": rnd.normal(size=(5, 5)), "skip": [1.0, 2.0]}
    field = pii.Field()
    field.add(0, "a11 b22 x c333 x d4444@e.fr y a11", [("email", 17, 27)])
    assert field.chain and field.skip
    assert np.allclose(pii.infer(field, model, rounds=60), _brute_marginals(field, model), atol=1e-6)


def test_redaction(spark, odd_docs):
    docs = spark.createDataFrame([(1, "to a@b.co and 10.1.2.3!"), (2, None)], "doc_id INT, text STRING")
    rows = {r.doc_id: r.text for r in pii.redact(docs, pii.fit(docs), carry=("doc_id",)).collect()}
    assert rows == {1: "to [EMAIL] and [IP]!", 2: None}


def test_sample_of_skewed_keys(spark, monkeypatch):
    monkeypatch.setattr(pii, "_from_counts", lambda table: sum(r["n"] for r in table if r["kind"] == 0))
    few = [(i, f"number {i}") for i in range(10)]
    for key in (None, 5):
        rows = few + [(key, f"row {i} of a hot key") for i in range(100)] + [(key, "row 0 of a hot key")] * 50
        assert pii.fit(spark.createDataFrame(rows, "doc_id INT, text STRING"), sample=20) == 20
    assert pii.fit(spark.createDataFrame(few * 3, "doc_id INT, text STRING"), sample=20) == 10


def test_pii_of_no_rows(no_docs):
    assert pii.find(no_docs, pii.fit(no_docs)).count() == 0


# --- near-duplicates ---


def _distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


def test_alignment_matches_the_full_table():
    rnd, pairs = random.Random(2), []
    for _ in range(400):
        a = [rnd.randrange(60) for _ in range(rnd.randint(1, 70))]
        b = list(a)
        for _ in range(rnd.randint(0, len(a) // 3 + 1)):
            i = rnd.randrange(len(b) + 1)
            b[i:i + rnd.randint(0, 1)] = [rnd.randrange(60)] * rnd.randint(0, 1)
        pairs.append((a, b or [1]))
    got = near_dedup.similar([(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) for a, b in pairs])
    expected = [1 - _distance(a, b) / max(len(a), len(b)) >= 0.8 - 1e-12 for a, b in pairs]
    assert got.tolist() == expected and any(expected) and not all(expected)


def test_components_match_brute_force(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u INT, v INT")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def _shingles(text):
    w = (text or "").encode().split()
    return [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_classes_match_brute_force(spark, odd_docs):
    rnd, rows = random.Random(8), []
    for g in range(12):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([3, 40, 150]))]
        for c in range(rnd.randint(1, 7)):
            words = list(base)
            for _ in range(0 if c % 3 == 0 else len(base) // 60):
                words[rnd.randrange(len(words))] = "new"
            rows.append((len(rows), " ".join(words)))
    texts = [_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            longer = max(len(texts[i]), len(texts[j]))
            if abs(len(texts[i]) - len(texts[j])) <= 0.2 * longer and len(set(texts[i]) & set(texts[j])) >= 0.5 * longer \
                    and 1 - _distance(texts[i], texts[j]) / longer >= 0.8 or texts[i] == texts[j]:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id INT, text STRING")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == {i: root(i) for i in range(len(rows))}


def _changed(rnd, words, n):
    out = list(words)
    for place in rnd.sample(range(len(out)), n):
        out[place] = f"n{rnd.randrange(10 ** 9)}"
    return out


def test_every_pair_of_a_bucket_is_compared_or_in_one_class(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8, raising=False)
    rnd, rows = random.Random(21), []
    common = [f"c{i}" for i in range(90)]
    for _ in range(12):
        words = common + [f"w{rnd.randrange(10 ** 9)}" for _ in range(60)]
        for _ in range(6):
            rows.append((len(rows), " ".join(words)))
            words = _changed(rnd, words, 4)
    rnd.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    texts = [near_dedup.sequence(near_dedup.zlib.compress(t.encode())) for _, t in rows]
    sketches = [near_dedup.order_minhash(t) for t in texts]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (sketches[i] == sketches[j]).any()]
    close = near_dedup.similar([(texts[i], texts[j]) for i, j in pairs])
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, j), yes in zip(pairs, close):
        if yes:
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    assert close.any() and not close.all()
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id INT, text STRING")).collect()}
    assert got == {i: root(i) for i in range(len(rows))}


def test_a_text_like_only_a_linked_text_is_found(spark):
    rnd = random.Random(138)
    hub = [f"w{rnd.randrange(10 ** 6)}" for _ in range(64)]

    def changed(words, first, last):
        return [f"n{rnd.randrange(10 ** 6)}" if first <= i < last else w for i, w in enumerate(words)]

    linked = changed(hub, 0, 8)
    far, other = changed(linked, 30, 34), changed(hub, 60, 62)
    texts = [near_dedup.sequence(near_dedup.zlib.compress(" ".join(w).encode())) for w in (hub, linked, far)]
    assert near_dedup.similar([(texts[0], texts[1]), (texts[1], texts[2]), (texts[0], texts[2])]).tolist() == [True, True, False]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((hub, other, linked, far))], "doc_id INT, text STRING")
    assert {r.class_id for r in near_dedup.classes(docs).collect()} == {0}


def test_outlines_keep_all_similar_pairs():
    rnd, texts = np.random.default_rng(5), []
    for size in (1, 3, 40, 300, 2_040, 2_055, 9_000):
        base = rnd.integers(0, 1 << 63, size, dtype=np.uint64)
        for share in (0.0, 0.1, 0.19, 0.3):
            text = base.copy()
            text[rnd.random(size) < share] = rnd.integers(0, 1 << 63)
            texts.append(text)
    lists = (np.arange(len(texts)), np.array([len(t) for t in texts]), [near_dedup.outline(t) for t in texts])
    found = set(zip(*(x.tolist() for x in near_dedup.possible(lists, lists))))
    every = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j]
    close = near_dedup.similar([(texts[i], texts[j]) for i, j in every])
    assert {p for p, yes in zip(every, close) if yes} <= found and len(found) < len(every) / 2


def test_texts_that_share_a_key_are_told_apart(spark):
    rnd = random.Random(5)
    a, b, c, d = ([f"w{rnd.randrange(10 ** 9)}" for _ in range(80)] for _ in range(4))
    near = [" ".join([*words[:-1], "other"]) for words in (a, b)]
    a, b, c, d = (" ".join(words) for words in (a, b, c, d))
    rows = [(1, a), (7, near[0]), (7, near[1]), (3, b), (7, c), (7, c), (7, d), (8, d)]
    docs = spark.createDataFrame(rows, "doc_id INT, text STRING").repartition(3)
    found = collections.Counter((r.doc_id, r.class_id, r.n_copies) for r in near_dedup.classes(docs).collect())
    assert found == {(1, 1, 1): 1, (7, 1, 1): 1, (7, 3, 1): 1, (3, 3, 1): 1, (7, 7, 2): 3, (8, 7, 2): 1}
    assert sorted(map(tuple, near_dedup.dedup(docs).collect())) == sorted([(1, a), (3, b), (7, c), (7, d)])


def test_dedup_of_odd_rows(odd_docs, odd_rows):
    classes = collections.Counter((r.doc_id, r.class_id) for r in near_dedup.classes(odd_docs).collect())
    assert sum(classes.values()) == len(odd_rows)
    assert classes[5, 5] == 3 and classes[6, 5] == 1 and classes[10, 9] == 1 and classes[None, None] == 1
    kept = near_dedup.dedup(odd_docs)
    assert kept.schema.names == odd_docs.schema.names
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids[5] == 1 and ids[6] == 0 and ids[None] == 1 and all(ids[i] == 1 for i in (0, 1, 2, 3, 9)) and ids[10] == 0


def test_dedup_of_no_rows(no_docs):
    assert near_dedup.classes(no_docs).count() == 0 and near_dedup.dedup(no_docs).count() == 0


# --- toxicity ---


def test_folding():
    assert toxicity.fold("1D10T, idіot! Ｉｄｉｏｔ") == " idiot idiot idiot "
    assert toxicity.fold(None) == " " and toxicity.fold(" \n") == "  "


def test_lexicon_matches_words_beginnings_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 2.0, " bad": 1.0, " badly ": 3.0}, ["idiot box"])
    found = lexicon.matches(" idiot box idiot badly badge rebad ")
    assert sorted(w for w, _ in found.values()) == [1.0, 2.0, 3.0]
    assert lexicon.features(" none ") == (0.0, 0.0, 0.0)


def _toxic_rows():
    rnd = random.Random(6)
    plain = ["red", "green", "blue", "house", "tree", "river", "stone", "cloud"]
    rows = []
    for i in range(900):
        words = [rnd.choice(plain) for _ in range(30)]
        toxic = int(i % 8 == 0)
        if toxic:
            words[rnd.randrange(30)] = rnd.choice(["moron", "M0ron", "mоron"])
        elif i % 8 in (1, 2):
            words[5:7] = ["moron", "museum"]
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_is_learned_with_exceptions(spark, odd_docs):
    rows = _toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id INT, text STRING")
    known = spark.createDataFrame([(i, x) for i, _, x in rows if i % 3], "doc_id INT, label INT")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    right = [got[i] == x for i, _, x in rows if i % 3 == 0]
    assert sum(right) / len(right) > 0.95


def test_toxicity_of_odd_rows(odd_docs, no_docs, odd_rows):
    known = odd_docs.select("doc_id", F.lit(0).alias("label"))
    model = toxicity.fit(odd_docs, known)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == len(odd_rows) and {r.score for r in rows} == {0.0}
    assert toxicity.accepted(odd_docs, model).count() == len(odd_rows)
    assert toxicity.score(no_docs, toxicity.fit(no_docs, known)).count() == 0


def test_toxicity_of_a_large_batch_takes_little_memory():
    scorer = toxicity.Scorer({"terms": {" bad": 1.0, " wo": 0.5}, "phrases": [], "weights": [-2.0, 0.5, 0.5, 0.5]})
    texts = [None, "", *(f"bad word {i} " * 200 for i in range(1500)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    texts = [(t or "")[:40] for t in texts]
    rows = 0
    tracemalloc.start()
    try:
        for part in toxicity._judged(scorer, batch, 0.3):
            assert part.column(0).to_pylist() == list(range(rows, rows + len(part)))
            assert part.column(3).to_pylist() == [400 if t else 0 for t in texts[rows:rows + len(part)]]
            rows += len(part)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # All matches of the batch at once take 100 MB, its texts as strings 4 MB.
    assert rows == len(texts) and peak < 8 << 20


# --- fingerprints ---


def test_sketches_round_trip_and_merge():
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 1000), (500, 1500), (0, 20), (0, 0))]
    a, b, c, d = fingerprints.sketches(pa.array(texts))
    both = fingerprints.sketches(pa.array([texts[0] + " " + " ".join(texts[1].split()[496:])]))[0]
    assert (fingerprints.decode(fingerprints.encode(a)) == a).all() and len(a) == fingerprints.K
    assert (fingerprints.merge(a, b) == both).all()
    assert fingerprints.resemblance(a, b) == pytest.approx(1 / 3, abs=0.12)
    assert fingerprints.distinct(a) == pytest.approx(996, rel=0.3) and fingerprints.distinct(c) == 16
    assert fingerprints.containment(c, a) == pytest.approx(1, abs=0.4)
    assert len(d) == 0 and fingerprints.resemblance(d, d) == 1 and fingerprints.resemblance(d, a) == 0


def test_next_texts_match_a_plain_loop(odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 4)
    rows = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.compare_with_next(odd_docs).collect())
    line = sorted(((r[0], r[1] or "") for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = collections.Counter()
    for i, (k, text) in enumerate(line):
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + line[(i + 1) % len(line)][1][:quarter]
        expected[k, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert rows == expected


def test_equal_texts_have_equal_fingerprints(odd_docs):
    rows = fingerprints.fingerprints(odd_docs).collect()
    assert len({r.fingerprint for r in rows if r.doc_id in (5, 6)}) == 1


def test_merged_fingerprints(spark, odd_docs):
    prints = fingerprints.fingerprints(odd_docs).join(odd_docs.select("doc_id", "lang").distinct(), "doc_id")
    merged = {r.lang: r.fingerprint for r in fingerprints.merged(prints, "lang").collect()}
    for lang in ("de", "ru"):
        parts = [fingerprints.decode(r.fingerprint) for r in prints.filter(F.col("lang") == lang).collect()]
        assert (fingerprints.decode(merged[lang]) == np.unique(np.concatenate(parts))[:fingerprints.K]).all()


def test_fingerprints_of_no_rows(no_docs):
    assert fingerprints.compare_with_next(no_docs).count() == 0


# --- languages ---


def test_code_lengths_match_a_plain_loop(odd_docs):
    model = language.fit(odd_docs)
    data = "Über the river".encode()
    got = language.code_lengths(model, np.frombuffer(data, dtype=np.uint8), np.array([0, 0, len(data)]))
    symbols = [int(model["code"][b]) for b in b"\n\n\n" + data]
    width, expected = model["width"], np.zeros(len(model["langs"]))
    for i in range(3, len(symbols)):
        row = model["row"][(symbols[i - 3] * width + symbols[i - 2]) * width + symbols[i - 1]]
        expected += model["bits"][row * width + symbols[i]]
    assert np.allclose(got[1], expected, atol=1e-2) and (got[0] == 0).all()


def test_language_distributions_sum_to_one(odd_docs):
    model = language.fit(odd_docs)
    share = np.exp2(-model["bits"].reshape(-1, model["width"], len(model["langs"])).astype(float)).sum(1)
    assert np.allclose(share, 1, atol=1e-3)


def test_languages_of_odd_rows(odd_docs, no_docs, odd_rows):
    rows = language.identify(odd_docs, language.fit(odd_docs)).collect()
    found = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == len(odd_rows)
    assert found[0] == found[1] == found[2] == found[15] == "und" and found[13] == "ru" and found[5] == "en"
    assert language.identify(no_docs, language.fit(no_docs)).count() == 0
    assert {r.lang_pred for r in language.identify(odd_docs, language.fit(no_docs)).collect()} == {"und"}


def test_held_out_languages(spark, sf_dir):
    from hearsay.llm.queries import op10_language

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = op10_language(spark, sf_dir).filter("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.9


def test_a_cell_gives_out_fewer_links_than_texts():
    base = [f"w{i}" for i in range(60)]
    groups = [[" ".join([*base, *(f"x{g}y{k}" for k in range(g * 300))][:60 + g * 200] + [f"end{t}"]) for t in range(12)] for g in range(3)]
    texts = [t for group in groups for t in group]
    bodies = [near_dedup.zlib.compress(t.encode()) for t in texts]
    i, j = np.triu_indices(len(texts), 1)
    links = near_dedup.joining(i, j, list(range(len(texts))), bodies, near_dedup.SIMILARITY)
    assert len(links) == len(texts) - 3
    assert all(i[k] // 12 == j[k] // 12 for k in links)
    # Classes that are joined already need no link.
    assert len(near_dedup.joining(i, j, [k // 6 for k in range(len(texts))], bodies, near_dedup.SIMILARITY)) == 3
