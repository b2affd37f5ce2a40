"""Piece encoding, alignment of tokenizers and periodic runs against the libraries and brute force, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("gridloom.llm")
import public_tokenizers
from gridloom.llm import align, merges, pieces, queries, runs

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, `__text` string, `__id` int, start string, pair long"
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "a\tb\n", "▁x", "x▁", "▁", "\0a", "<s> <0x41> <unk> <|endoftext|>", "\xa0x", "　é", "😀😀 z", "z" * 5000, "ab" * 900 + " " * 50 + "x", "it's we'll 'S x'st ''s", "\x1c\x1d a\x1f", "\U0010ffff�"]


def some_texts():
    rng = random.Random(7)
    mixed = ["".join(rng.choice("ab \t\n▁'é😀zxq'the1ing\x85") for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    ranges = [(1, 127), (128, 0x3000), (0x4E00, 0xD7FF), (0x1F300, 0x1FA00), (0x10000, 0x2FFFF)]
    wide = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    words = ["the", "quick", "überhaupt", "Straße", "naïve", "x1", "don't", "\n"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    return ODD + mixed + wide + prose + [prose[0], prose[0], " ".join(prose) * 5]


def documents(spark, texts):
    """Documents with a null text, a null id, a repeated row and columns whose names could clash."""
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(100_000, None, None, None), (None, "the quick", "en", "a"), (3, texts[3], "en", "a")]
    return spark.createDataFrame([(*r, "n", "t", 7, "s", 1) for r in rows], SCHEMA).repartition(5), [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(pieces.read_pieces(PIECES))


def digest(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_pieces_equal_the_library(spark, library):
    docs, rows = documents(spark, some_texts())
    shared = pieces.broadcast_codec(spark, PIECES)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "")
        want[i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))] += 1
    assert Counter(tuple(r) for r in pieces.encode_digests(docs, shared).collect()) == want
    encoded = pieces.encode_documents(docs, shared)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((i, tuple(library.encode(t or ""))) for i, t in rows)
    assert Counter((r.doc_id, r.decoded) for r in pieces.decode_ids(encoded, shared).collect()) == Counter((i, library.decode(library.encode(t or ""))) for i, t in rows)
    assert pieces.encode_digests(docs.where("false"), shared).count() == 0


def test_decoding_of_any_ids(library, codec):
    rng = random.Random(1)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3), rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(259, 32000), 28705]) for _ in range(rng.randrange(9))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_each_distinct_chunk_is_segmented_once(codec):
    codec.warm()
    met = []
    segment = codec.table.segment
    codec.table.segment = lambda c: (met.extend(c.to_pylist()), segment(c))[1]
    codec.encode(["one two one", "two  three", None and "", "one"])
    codec.encode(["three one", "four"])
    assert Counter(met) == Counter([b" one", b" two", b"  three", b" three", b" four"])
    codec.warm()


def test_a_full_table_starts_anew(codec, library, monkeypatch):
    monkeypatch.setattr(merges, "MOST_CHUNKS", 5)
    codec.warm()
    for text in some_texts()[:60]:
        assert codec.encode([text])[0].tolist() == library.encode(text)
        assert codec.digests([text])[1] == [digest(",".join(map(str, library.encode(text))))]
    assert codec.table.age > 3
    codec.warm()


def test_vocabulary_with_markers_inside_pieces():
    rows = [("<unk>", 0.0, "unknown"), *[(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]]
    rows += [(p, -float(i), "normal") for i, p in enumerate(["▁", "a", "b", "a▁", "a▁b", "▁a"])]
    own = pieces.PieceCodec(rows)
    assert not own.local and [rows[i][0] for i in own.encode(["a b a"])[0]] == ["▁", "a▁b", "▁a"]


def test_merges_in_matrices_equal_those_by_heap():
    rng = np.random.default_rng(0)
    pairs = np.unique(rng.integers(0, 40, (300, 2)), axis=0)
    own = merges.Merges(pairs[:, 0], pairs[:, 1], rng.permutation(len(pairs)) // 3, rng.integers(0, 40, len(pairs)), 40)
    lengths = rng.integers(0, 33, 500)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    symbols = rng.integers(0, 41, offsets[-1]).astype(np.int32)
    ids, ends = own.apply(symbols, offsets)
    for i in range(500):
        assert ids[ends[i] : ends[i + 1]].tolist() == own.one(symbols[offsets[i] : offsets[i + 1]]).tolist()


def aligned_by_brute_force(rows, library):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    alphabet = align.byte_alphabet()
    found = []
    for i, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = library.encode(text or "")
        raw_a = [bytes(alphabet[c] for c in t.id_to_token(x)) for x in a]
        raw_b = [bytes([int(library.id_to_piece(x)[1:-1], 16)]) if library.is_byte(x) else library.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            a, b, raw_a, raw_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        spans = [[(e - len(x), e) for e, x in zip(ends, raw, strict=True)] for ends, raw in ((ends_a, raw_a), (ends_b, raw_b))]
        links, first = [], 0
        for x, (s, e) in zip(a, spans[0], strict=True):
            while first < len(b) and spans[1][first][1] <= s:
                first += 1
            j = first
            while j < len(b) and spans[1][j][0] < e:
                links.append((x, b[j]))
                j += 1
        groups, last = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append("|".join(",".join(str(x) for x, (_, e) in zip(ids, span, strict=True) if last < e <= cut) for ids, span in zip((a, b), spans, strict=True)))
            last = cut
        found.append((i, len(a), len(b), len(groups), links, digest(";".join(groups)) if a else ""))
    held = Counter(p for row in found for p in set(row[4]))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return Counter((i, n, m, g, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), s) for i, n, m, g, links, s in found)


@pytest.mark.parametrize("most_pairs", [align.MOST_PAIRS, 0])
def test_alignment(spark, library, most_pairs):
    texts = [t for t in some_texts() if len(t) < 3000]
    docs, rows = documents(spark, texts)
    aligner = align.broadcast_aligner(spark, BYTES, PIECES)
    out = align.align(docs, aligner, most_pairs=most_pairs)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in out.collect()) == aligned_by_brute_force(rows, library)
    assert align.align(docs.where("false"), aligner, most_pairs=most_pairs).count() == 0
    assert align.align(docs.where("text is null"), aligner, most_pairs=most_pairs).collect()[0].n_links == 0


def runs_by_brute_force(i, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        w = [w[k] if k < a else w[a + (k - a) % (1 + (n - a) // (3 + g % 8))] for k in range(n)]
    found = {}
    for p in range(1, n // 3 + 1):
        k = 0
        while k + p < n:
            s = k
            while k + p < n and w[k] == w[k + p]:
                k += 1
            if k > s and k + p - s >= max(24, 3 * p):
                found.setdefault((s, k + p - s), p)
            k += k == s
    rows = sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))
    best = min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for s, length, p in rows for k in range(s + p, s + length)}
    rest = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(rows), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{length},{p}\n" for s, length, p in rows)), digest(rest))


def test_runs(spark):
    rng = random.Random(3)
    texts = [*ODD[:12], "a " * 400, "a b " * 12, "a b c " * 8, "x " + "a b c d e f g h i " * 3, "x " * 23, "x " * 24, " ".join(f"w{i % 7}" for i in range(23)), "aa " * 30 + "aaa " * 30, " ".join(f"w{i}" for i in range(400)) * 3]
    for _ in range(400):
        w = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.choice([0, 1, 5, 24, 60, 150]))]
        at, block = rng.randrange(len(w) + 1), [rng.choice("abcxyz") for _ in range(rng.randrange(1, 12))]
        w[at:at] = (block * 40)[: rng.randrange(90)]
        texts.append("".join(x + rng.choice([" ", "  ", "\n", " \t"]) for x in w))
    docs, rows = documents(spark, texts)
    out = runs.periodic_runs(docs)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in out.collect()) == Counter(runs_by_brute_force(i, t) for i, t in rows)
    assert runs.periodic_runs(docs.where("false")).count() == 0


def test_runs_of_long_texts(monkeypatch):
    monkeypatch.setattr(runs, "MOST_POINTS", 5000)  # many parts of grids
    words = np.concatenate([np.zeros(3000, np.int64), np.arange(2000), np.tile(np.arange(700), 4), [5]])
    start, end, period = runs.find_runs(words, np.array([0, 0, len(words), len(words)]))
    # the run of zeros takes in the 0 after it; the tiles begin where the words before them do not go on
    assert list(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)) == [(0, 3001, 1), (5000, 7800, 700)]


@pytest.mark.parametrize("name", ["op11_token_alignment", "op12_sentencepiece", "op13_periodic_runs"])
def test_queries(spark, name, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in queries.queries()[name](spark, SF).collect())
    if name == "op11_token_alignment":
        assert got == aligned_by_brute_force(rows, library)
    elif name == "op12_sentencepiece":
        ids = {i: library.encode(t or "") for i, t in rows}
        assert got == Counter((i, len(x), digest(",".join(map(str, x))), digest(library.decode(x))) for i, x in ids.items())
    else:
        assert got == Counter(runs_by_brute_force(i, t) for i, t in rows if len(t or "") < 20_000) + Counter({r: n for r, n in got.items() if len(dict(rows)[r[0]] or "") >= 20_000})
