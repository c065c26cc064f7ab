"""The training-data operators against brute force, with nulls, ties, repeated rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from claimspark.llm.attention import WINDOW, Attention, Tree, text_scores, trained
from claimspark.llm.ball_tree import build, search, top_k
from claimspark.llm.ngram_join import components, ngram_components, one_per_component
from claimspark.llm.packing import difference, pack_block, packed_documents
from claimspark.llm.pieces import PieceModel, decoded, encoded, piece_digests
from claimspark.llm.sketches import text_sketches
from claimspark.llm.substrings import with_cuts, without_repeats
from claimspark.llm.subwords import encoder
from claimspark.llm.token_files import EliasFano, token_files
from claimspark.llm.toxicity import toxicity_scores
from claimspark.llm.warc import archived_pages

SCHEMA = "doc_id long, text string, n long, row long, id long, cuts int, ids int, digest string, score string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    shared = [word() for _ in range(60)]
    found = [None, "", "  \n ", "one", "one two", " ".join(base), " ".join(base).upper(), " ".join(base)]
    for i in range(25):
        near = list(base)
        near[i * 3 % 120] = word()
        found.append(" ".join(near))
    found += [" ".join([word() for _ in range(40)] + shared + [word() for _ in range(30)]) for _ in range(4)]
    found += [" ".join(shared[:35] + shared[:35]), "é 漢字 🙂 " * 30 + "\n\nline  two\ttabs ", " ".join(word() for _ in range(3000))]
    return found


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, 2, 3, 4, 5, "x", "y") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + [rows[12], (None, "no id here", 1, 2, 3, 4, 5, "x", "y")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize(("size", "percent", "frequent"), [(3, 90, 1), (3, 90, 24), (5, 80, 3)])
def test_components(docs, size, percent, frequent):
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    of = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and 100 * len(a & b) >= percent * len(a | b):
                    of[i] = of[j] = min(of[i], of[j])
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if of[j] == of[i] and rows[j].doc_id is not None]
        want.append((r.doc_id, len(sets[i]), min(ids, default=None)))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, ngram_components(docs, size, percent, frequent).collect()), key=key) == sorted(want, key=key)


def test_one_document_of_each_component_stays(docs, empty):
    kept = one_per_component(docs, 3, 90)
    assert kept.columns == docs.columns
    assert {5, 6, 7, 12} & {r.doc_id for r in kept.collect()} == {5}
    assert ngram_components(empty).count() == one_per_component(empty).count() == 0


def test_pipeline_stage_judges_rows_not_ids(spark):
    import corpus_pipeline

    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (5, a + " tail"), (5, b), (7, c), (7, d), (None, b + " end"), (None, "x y"), (None, "x y"), (8, "x y z"), (8, "x y z"), (9, None), (9, None), (None, " ")]
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    of = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and 100 * len(x & y) >= 80 * len(x | y):
                    of[i] = of[j] = min(of[i], of[j])
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [min((rows[i] for i in range(len(rows)) if of[i] == k), key=order) for k in set(of)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert dict(components(links).collect()) == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_repeats(docs, empty):
    rows, times = docs.select("doc_id", "text").collect(), Counter()
    for r in rows:
        w = words(r.text)
        times.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for r in rows:
        w = words(r.text)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if times[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((str(r.doc_id), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = with_cuts(docs).select("doc_id", "cuts.n_words", "cuts.n_removed", "cuts.kept_sha256").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert without_repeats(docs).columns == docs.columns
    assert without_repeats(empty).count() == 0
    clean = {r.doc_id: r.text for r in without_repeats(docs).collect()}
    assert clean[2] == "  \n " and clean[0] is None


def test_sketches(docs, empty):
    rows = sorted((r for r in docs.select("doc_id", "text").collect() if r.doc_id is not None), key=lambda r: (-r.doc_id, r.text or ""))
    cut = lambda t: {x[i : i + 160] for x in t.split("\n") for i in range(0, len(x), 160)}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = []
    for r, n in zip(rows, rows[1:] + rows[:1]):
        t, after = r.text or "", n.text or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        want.append((r.doc_id, len(t), digest, alike(cut(t), cut(edited)), alike(cut(t), cut(after))))
    found = text_sketches(docs).collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found if r.doc_id is not None]
    assert sorted(got) == sorted(want)
    prints = {r.doc_id: r.fingerprint for r in found}
    assert prints[5] == prints[7] != prints[6]
    assert text_sketches(empty).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[0][1]) for i in range(20)] + [(400, None), (450, [float("nan")] * 6), (350, [None] * 6), (None, [1.0] * 6)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    whole = {i: np.floor(256 * np.float32(v).astype(np.float64)).astype(int) for i, v in vectors[:320]}
    want = []
    for q in range(0, 320, 50):
        scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert sorted(map(tuple, top_k(frame, 50, 5).collect())) == want
    assert top_k(frame.limit(0), 50, 5).count() == 0


def test_bounds_skip_leaves():
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(4000, 8)) * 256).astype(np.int64) + np.repeat(rng.integers(-4000, 4000, (20, 8)), 200, axis=0)
    names = np.arange(len(vectors))
    best, held, visited = search(vectors, names, vectors[:50], names[:50], np.full(50, -(1 << 60)), 5)
    scores = vectors[:50] @ vectors.T
    scores[np.arange(50), np.arange(50)] = -(1 << 62)
    assert (np.sort(scores, axis=1)[:, ::-1][:, :5] == best).all()
    assert visited < 50 * sum(n[0] is not None for n in build(vectors)) / 2


def test_pieces(docs, empty):
    model = PieceModel(PIECES)
    assert model.decode(model.encode(" a  b\x00é🙂 ")) == " a  b\x00é🙂 "
    for text in ("banana", "theory"):
        marked = "▁" + text
        at = [0.0] + [-1e18] * len(marked)
        for j in range(1, len(at)):
            at[j] = max(at[i] + score for i in range(j) if (score := model_score(model, marked[i:j])) is not None)
        assert sum(model_score(model, model.text[i]) for i in model.encode(text)) == pytest.approx(at[-1])
    back = decoded(encoded(docs, PIECES), PIECES).select("text", "decoded").collect()
    assert all((t or "") == d for t, d in back)
    assert piece_digests(docs, PIECES).count() == docs.count()
    assert piece_digests(empty, PIECES).count() == 0


def model_score(model, piece):
    state = 0
    for letter in piece:
        state = model.automaton.goto[state].get(letter)
        if state is None:
            return None
    return model.automaton.piece[state][2] if model.automaton.piece[state] else None


def test_scores_of_texts(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    tokens = [[*words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")), None] for r in rows]
    out = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    count = Counter(t for own, held in zip(tokens, out) if not held for t in own)
    total = sum(count.values())
    want = sorted(
        (str(r.doc_id), held, len(own), sum(count[t] > 0 for t in own), total, round(float(sum(np.log10((count[t] + 1) / (total + len(count) + 1)) for t in own)), 6))
        for r, own, held in zip(rows, tokens, out)
    )
    got = text_scores(docs, BYTES).collect()
    assert sorted((str(r[0]), *r[1:5], round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert text_scores(empty, BYTES).count() == 0


def test_attention_learns_from_long_texts(spark):
    phrase = "zebra lamp quartz violin harbour"
    train = spark.createDataFrame([(1, " ".join([phrase] * 5000)), (2, "a short one")], "doc_id long, text string")
    size = encoder(BYTES).tokenizer.get_vocab_size()
    ids = [np.asarray(x, np.int64) for _, x in encoder(BYTES).encode([" ".join([phrase] * 6)])][0][:WINDOW]
    counts = np.bincount(ids, minlength=size) * 5000 // 6
    model, before = trained(train, BYTES, counts), Attention(Tree(counts))
    assert model.logs(ids[None, :-1], ids[None, 1:]).mean() > before.logs(ids[None, :-1], ids[None, 1:]).mean() + 0.3


def test_attention_gradients_and_whole_distribution():
    rng = np.random.default_rng(0)
    model = Attention(Tree(rng.integers(0, 50, 40)))
    model.part("node")[:] = rng.normal(0, 0.3, model.part("node").shape)
    given, target, weight = rng.integers(0, 41, (2, 10)), rng.integers(0, 40, (2, 10)), rng.random((2, 10)) < 0.7
    assert sum(10 ** model.logs(given, np.full(given.shape, i)) for i in range(40)) == pytest.approx(1, abs=1e-6)
    model.table = model.table.astype(np.float64)
    loss = lambda: -np.log(10) * (model.logs(given, target) * weight).sum() / weight.sum()
    for row, slope in list(zip(*model.gradients(given, target, weight)))[::5]:
        model.table[row, 3] += 1e-4
        up = loss()
        model.table[row, 3] -= 2e-4
        assert (up - loss()) / 2e-4 == pytest.approx(slope[3], abs=1e-6)
        model.table[row, 3] += 1e-4


def test_packing(docs, empty):
    found = packed_documents(docs, WORDS, 1, 64).collect()
    held = {}
    for r in found:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packed_documents(empty, WORDS, 1, 64).count() == 0
    sizes = [8, 7, 6, 5, 4]
    sums = [sum(sizes[i] for i in w) for w in difference(sizes, 2)]
    assert sum(sums) == 30 and max(sums) - min(sums) <= 2
    assert all(sum(w) <= 10 for w in ([[6, 6, 6][i] for i in x] for x in pack_block([6, 6, 6], 10)))


def test_token_files(docs, empty):
    found = sorted(token_files(docs, BYTES, 2).collect(), key=lambda r: r.start)
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    assert len(found) == docs.count() and token_files(empty, BYTES, 2).count() == 0
    values = np.sort(np.random.default_rng(0).integers(0, 10**12, 700))
    coded = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    assert coded.values().tolist() == values.tolist() == [coded.select(i) for i in range(700)]


def test_toxicity(spark, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["fine", "good", "day", "tree"]) for _ in range(20)) + (" horrible idiots" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows + [(900, None), (901, "horribble idiotts")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1)], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity_scores(docs, labels).collect()}
    assert min(score[i] for i in range(0, 200, 4)) > max(score[i] for i in range(1, 200, 4)) and score[901] > score[1]
    assert toxicity_scores(empty, labels).count() == 0


def test_archives(spark):
    pages = [(3, "u", "same"), (1, None, "same"), (2, "u\r\nv", None), (4, "u", ""), (None, "u", "same"), (5, "u", "é\r\n\r\nWARC/1.1")]
    found = {r.page_id: r for r in archived_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in found.items()} == {
        1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("revisit", 2), 5: ("response", None), None: ("revisit", 1)
    }
    assert found[5].payload_bytes == len("é\r\n\r\nWARC/1.1".encode())
