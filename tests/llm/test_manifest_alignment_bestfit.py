"""Merkle manifest, tokenizer alignment and best-fit packing against plain recomputation."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from claimspark.llm.alignment import ByteSide, PieceSide, aligned_documents
from claimspark.llm.bestfit import OpenBins, best_fit, best_fit_documents
from claimspark.llm.manifest import Block, address, addresses, manifest_proofs, subtree_size
from claimspark.llm.packing import packed_documents
from claimspark.llm.subwords import CachedEncoder
from claimspark.llm.token_files import token_files

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# Further columns have the names that the operators use inside.
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, row long, idx long, n string, tree int, root int, length int, piece int, pairs string, total int"


def rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé漢🙂.,'1 ") for _ in range(rng.randint(1, 9)))
    found = []
    for i in range(140):
        text = "\n".join(" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 4)))
        source = "hot" if i % 3 else rng.choice([None, "", "a", "é", "z", "one%d" % i])
        found.append((i * 7, source, rng.choice(["en", None]), len(text), text))
    found += [(7, "hot", "en", 3, "a\nb"), (7, "hot", "en", 3, "a\nb"), (None, "hot", None, None, None), (None, None, None, 0, "")]
    found += [(5000, "hot", "en", 1, "<|endoftext|> <s> x </s>"), (5001, "a", "en", 1, "a▁b"), (5002, "a", "en", 1, " \n\t  two  blanks \x00 ")]
    found += [(5003, "hot", "en", 9, "x" * 30_000), (5004, "hot", "en", 9, "some words \n" * 3_000), (5005, "z", "en", 4, "<0x41>İ. 1")]
    return [(*r, 1, 2, "n", 4, 5, 6, 7, "p", 8) for r in found]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(r):
    return tuple((x is not None, x) if not isinstance(x, bool) else (True, x) for x in r)


# --- manifest


def test_addresses_keep_subtrees_together():
    assert address(4, 0, np.array([0])).tolist() == [0]
    for levels in range(1, 7):
        places = np.concatenate(addresses(levels))
        assert sorted(places.tolist()) == list(range(subtree_size(levels)))
    # Four levels: a top of two, then nine bottoms of two levels, each in one stretch.
    for i in range(9):
        own = [int(addresses(4)[2][i]), *addresses(4)[3][3 * i : 3 * i + 3].tolist()]
        assert own == list(range(4 + 4 * i, 8 + 4 * i))


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def path(levels, at):
    for level in levels[:-1]:
        first = at - at % 3
        yield level[first : first + 3], at - first
        at //= 3


def plain_manifest(given):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for doc_id, source, lang, n_chars, text, *_ in given:
        leaf = h(*map(field, (doc_id, source, lang, n_chars, text)))
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        changed = h(*map(field, (doc_id, source, lang, n_chars, text.replace("\n", "") if even and text else text)))
        by.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, changed, doc_id))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([r[2] for r in sorted(by[s], key=lambda r: r[:3])]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    for place, s in enumerate(names):
        for at, (_, _, leaf, changed, doc_id) in enumerate(sorted(by[s], key=lambda r: r[:3])):
            steps = [*path(trees[s], at), *path(top, place)]
            fold = changed
            for run, own in steps:
                fold = h(*run[:own], fold, *run[own + 1 :])
            siblings = [x for run, own in steps for i, x in enumerate(run) if i != own]
            yield doc_id, leaf, trees[s][-1][0], top[-1][0], h(*siblings), fold, fold == top[-1][0]


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest(docs, empty, height):
    columns = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    found = manifest_proofs(docs, height)
    assert sorted(map(tuple, found.select(columns).collect()), key=order) == sorted(plain_manifest(rows()), key=order)
    if height == 2:
        assert not found.filter("not verified").isEmpty() and manifest_proofs(empty, height).count() == 0


def test_block_paths_of_incomplete_runs():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(10)]
    levels = climb([x.hex() for x in leaves])
    block = Block.of(leaves, len(levels))
    assert block.root.hex() == levels[-1][0] and block.leaf(9) == leaves[9]
    assert block.path(9)[:4] == bytes([0, 0, 0, 0])  # alone at the lowest two levels


# --- alignment


def plain_alignment(given):
    a_side, b_side = ByteSide(BYTES), PieceSide(PIECES)
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    found, pairs = [], Counter()
    for doc_id, _, _, _, text, *_ in given:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.model.encode(text) if text else []
        want = (" " + (text or "")).encode()
        sides = [[side.bytes[i] for i in ids] for side, ids in ((a_side, a), (b_side, b))]
        if not text or any(b"".join(s) != want for s in sides):
            a, b, sides = [], [], [[], []]
        spans = []
        for side in sides:
            ends = np.cumsum([len(x) for x in side]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        links, j = [], 0
        for i, (start, end) in enumerate(spans[0]):
            while j and spans[1][j][0] > start or j < len(b) and j and spans[1][j - 1][1] > start:
                j -= 1
            while j < len(b) and spans[1][j][0] < end:
                if spans[1][j][1] > start:
                    links.append((a[i], b[j]))
                j += 1
            j = min(j, len(b) - 1)
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in shared:
            own = [",".join(str(x) for x, (s, e) in zip(ids, span) if low < e <= cut) for ids, span in zip((a, b), spans)]
            groups.append("|".join(own))
            low = cut
        pairs.update(links)
        found.append((doc_id, len(a), len(b), len(shared), links, ";".join(groups)))
    most = {}
    for (_, y), n in pairs.items():
        most[y] = max(most.get(y, 0), n)
    for doc_id, n_a, n_b, n_groups, links, text in found:
        best = sum(pairs[x] == most[x[1]] for x in links)
        digest = h(text) if n_a else ""
        yield doc_id, n_a, n_b, n_groups, len(links), best, sum(pairs[x] for x in links), digest


def test_alignment(docs, empty, monkeypatch):
    given = [r for r in rows() if len(r[4] or "") < 2_000]
    want = sorted(plain_alignment(given), key=order)
    small = docs.filter("text is null or length(text) < 2000")
    assert sorted(map(tuple, aligned_documents(small, BYTES, PIECES).collect()), key=order) == want
    # Nearly all pairs rare: they are joined instead of broadcast.
    monkeypatch.setattr("claimspark.llm.alignment.HOT_PAIRS", 20)
    assert sorted(map(tuple, aligned_documents(small, BYTES, PIECES).collect()), key=order) == want
    kinds = {r[0]: r[1:] for r in want}
    assert kinds[5001] == (0, 0, 0, 0, 0, 0, "") and kinds[5000][0] > 0
    assert aligned_documents(empty, BYTES, PIECES).count() == 0


def test_long_texts_are_aligned_whole(docs):
    found = {r.doc_id: r for r in aligned_documents(docs.filter("doc_id in (5003, 5004)"), BYTES, PIECES).collect()}
    library = Tokenizer.from_file(BYTES)
    for doc_id, text in ((5003, "x" * 30_000), (5004, "some words \n" * 3_000)):
        row = found[doc_id]
        assert row.n_a == len(library.encode(" " + text, add_special_tokens=False).ids)
        assert row.n_links == row.n_a + row.n_b - row.n_groups


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = [chr(c) for c in range(32, 0x250)] + list(" \n\t\r\x0b\x0c\x85\xa0 ̇İıßΣςéﬁ漢字🙂٣½Ⅷ'`’") * 6 + [" "] * 150
    pieces = ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", "İ. 1", "<|endo", " 's"]
    return ["".join(rng.choice(letters) if rng.random() < 0.93 else rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_byte_side_equals_the_library():
    texts, side, library = random_texts(5_000, 4), ByteSide(BYTES), Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    want = library.encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert [side.encode(t) for t in texts] == [e.ids for e in want]


# --- encoder and packing


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_cached_encoder_equals_the_library(path):
    texts = random_texts(20_000, 3)
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    held = CachedEncoder(path, limit=3_000)  # starts afresh many times
    assert [ids.tolist() for _, ids in held.encode(texts)] == [e.ids for e in want]


def ids_of(given, path, end_id):
    found = Tokenizer.from_file(path).encode_batch([r[4] or "" for r in given], add_special_tokens=False)
    return [np.array([*e.ids, end_id], "<u4") for e in found]


def check_sequences(found, capacity):
    held = {}
    for r in found:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("open_bins", [1, 4, 2048])
def test_best_fit(docs, empty, open_bins):
    found = best_fit_documents(docs, WORDS, 1, 64, open_bins).collect()
    want = []
    for r, ids in zip(rows(), ids_of(rows(), WORDS, 1)):
        for n, at in enumerate(range(0, len(ids), 64)):
            want.append((r[0], n, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())))
    assert sorted((tuple(r[:5]) for r in found), key=order) == sorted(want, key=order)
    used = check_sequences(found, 64)
    least = -(-sum(r.length for r in found) // 64)
    assert used <= (1.05 * least if open_bins == 2048 else 2 * least)
    if open_bins == 4:
        assert best_fit_documents(empty, WORDS, 1, 64).count() == 0


def test_extra_columns_of_pieces_stay(spark):
    pieces = spark.createDataFrame([(5, "a", 1, 2), (60, "b", 1, 2), (64, "c", 1, 2), (4, "d", 1, 2)], "length int, name string, sequence_id int, offset int")
    found = best_fit(pieces, 64)
    assert found.columns == ["length", "name", "sequence_id", "offset"]
    assert check_sequences(found.collect(), 64) == 3


def test_open_bins_take_the_best_fit_and_close_the_fullest():
    bins = OpenBins(10, 2)
    assert [bins.place(n, i) for i, n in enumerate([6, 7, 3, 10])] == [(0, 0), (1, 0), (1, 7), (3, 0)]
    assert bins.count == 1  # bin 1 is full and closed, bin 3 never opened
    assert bins.place(5, 4) == (4, 0)
    assert bins.place(8, 5) == (5, 0)  # bin 0 with 6 of 10 closes, as it is fuller than bin 4
    assert bins.place(4, 6) == (4, 5)


def test_packed_documents_hold_every_id_once(docs):
    found = packed_documents(docs, WORDS, 1, 64).collect()
    check_sequences(found, 64)
    want = Counter()
    for r, ids in zip(rows(), ids_of(rows(), WORDS, 1)):
        full = len(ids) - len(ids) % 64
        for at in [*range(0, full, 64), *range(full, len(ids), 16)]:
            own = ids[at : at + (64 if at < full else 16)]
            want[(r[0], at, len(own), zlib.crc32(own.tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == want


def test_token_files_hold_the_ids_of_the_library(docs):
    found = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files(docs, BYTES, 2).collect()]
    want = [(r[0], len(ids), zlib.crc32(ids.tobytes())) for r, ids in zip(rows(), ids_of(rows(), BYTES, 2))]
    assert sorted(found, key=order) == sorted(want, key=order)
