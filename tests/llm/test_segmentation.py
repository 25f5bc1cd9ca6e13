import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from quern.llm import segmentation

SP = sentencepiece.SentencePieceProcessor(model_file=segmentation.MODEL)
BYTE = {int(SP.id_to_piece(i)[1:-1], 16): i for i in range(SP.get_piece_size()) if SP.is_byte(i)}
PIECES = {SP.id_to_piece(i): i for i in range(SP.get_piece_size()) if not (SP.is_byte(i) or SP.is_control(i) or SP.is_unknown(i) or SP.is_unused(i))}


def every(text):
    """Every segmentation's ids and its probability, by plain recursion over the vocabulary."""
    shown = (" " + text).replace("▁", "\0").replace(" ", "▁")
    most = max(map(len, PIECES))

    def ways(at):
        if at == len(shown):
            return [((), 1.0)]
        out = []
        for n in range(1, min(most, len(shown) - at) + 1):
            piece = shown[at : at + n]
            if piece in PIECES:
                step = (PIECES[piece],)
            elif n == 1:
                step = tuple(BYTE[b] for b in ("▁" if piece == "\0" else piece).encode())
            else:
                continue
            rank = SP.get_piece_size() if len(step) > 1 else step[0]
            out += [(step + rest, w * (rank + 10.0) ** -segmentation.SMOOTHING) for rest, w in ways(at + n)]
        return out

    found = ways(0)
    total = sum(w for _, w in found)
    return {ids: w / total for ids, w in found}


def drawn(text, seeds, k):
    lattices = segmentation.Lattices(segmentation.Pieces.of(segmentation.MODEL))
    for own, left in segmentation.segment(lattices, [text] * seeds, np.arange(seeds, dtype=np.uint64), k):
        yield [(tuple(lattices.pieces.plain(lattices.ids[x.edges]).tolist()), x.along[-1], x.value) for x in own], left


@pytest.mark.parametrize("text", ["", "a", "the", "of  a", "x▁y", "日é", "\n\n ", "1,5)", "데"])
def test_all_segmentations_come_out_once(text):
    want = every(text)
    for got, left in drawn(text, 3, len(want) + 2):
        assert len(got) == len(want) and left == -math.inf
        assert all(abs(lp - math.log(want[ids])) < 1e-9 for ids, lp, _ in got)
        assert {ids for ids, *_ in got} == set(want) and [v for *_, v in got] == sorted((v for *_, v in got), reverse=True)


@pytest.mark.parametrize("text", ["there", "in the", "a  b"])
def test_samples_follow_the_probabilities(text):
    """The first sample falls as the probabilities say, the second as they say without the first, and the scores weigh the samples rightly."""
    want, n = every(text), 4_000
    first, second, pairs, weighed = Counter(), Counter(), Counter(), []
    for got, left in drawn(text, n, 2):
        assert len({ids for ids, *_ in got}) == 2
        first[got[0][0]] += 1
        second[got[1][0]] += 1
        pairs[got[0][0], got[1][0]] += 1
        weighed.append(sum(math.exp(lp) / segmentation.inclusion(lp, left) for _, lp, _ in got))
    near = lambda seen, p: abs(seen / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 3 / n
    assert all(near(first[ids], p) for ids, p in want.items())
    assert all(near(pairs[a, b], p * q / (1 - p)) for a, p in want.items() for b, q in want.items() if a != b)
    assert abs(np.mean(weighed) - 1) < 5 * np.std(weighed) / math.sqrt(n)


def test_more_samples_and_their_places():
    """Perturbed values of the best five of many segmentations: distinct, falling, the first as a Gumbel variable."""
    text, firsts = "segmentations of a text", []
    for got, left in drawn(text, 1_500, 5):
        values = [v for *_, v in got] + [left]
        assert len({ids for ids, *_ in got}) == 5 and values == sorted(values, reverse=True)
        firsts.append(values[0])
    assert abs(np.mean(firsts) - 0.5772) < 0.17 and abs(np.var(firsts) - math.pi**2 / 6) < 0.4


def test_rows(spark):
    texts = ["", "a", "▁x  y\n\n z日本\U0001f600", "the the", None, "w" * 5_000, "a" + " " * 40 + "b", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for k in (1, 2, 4):
        by: dict = {}
        for x in segmentation.encode(docs, samples=k).collect():
            assert x.decoded == (texts[x.doc_id] or "") and x.round_trip and 0 <= x.inclusion <= 1 and x.n_pieces == len(x.ids)
            by.setdefault(x.doc_id, []).append((x.sample, tuple(x.ids), x.perturbed))
        assert {i: len(v) for i, v in by.items()} == {i: min(k, len(every(t or "")) if len(t or "") < 9 else k) for i, t in enumerate(texts)}
        assert all(len({ids for _, ids, _ in v}) == len(v) and [g for *_, g in sorted(v)] == sorted((g for *_, g in v), reverse=True) for v in by.values())


def test_same_whatever_stands_beside():
    """What a row gets depends on its id and text alone: not on its neighbours, and not on what the worker has seen."""
    r = random.Random(8)
    texts = ["".join(r.choice(["the ", "house", "ß", " ", "\n", "日", "q7"]) for _ in range(r.randint(0, 60))) for _ in range(40)]
    seeds = np.arange(40, dtype=np.uint64)
    pieces = segmentation.Pieces.of(segmentation.MODEL)
    lattices = segmentation.Lattices(pieces)
    facts = lambda lattices, got: [(lattices.ids[x.edges].tolist(), x.along[-1], x.value, left) for own, left in got for x in own]
    whole = facts(lattices, segmentation.segment(lattices, texts, seeds, 3))
    again = facts(lattices, segmentation.segment(lattices, texts, seeds, 3))
    alone = []
    for i in reversed(range(40)):
        fresh = segmentation.Lattices(pieces)
        alone = facts(fresh, segmentation.segment(fresh, texts[i : i + 1], seeds[i : i + 1], 3)) + alone
    assert whole == again == alone


def test_few_rows_are_walked_together_and_none_is_left_out(monkeypatch):
    rows, sizes = 3 * segmentation.ROWS + 7, []
    batch = pa.record_batch({"doc_id": range(rows), "seed": pa.array(range(rows), pa.int64()), "text": [f"row {i} of many" for i in range(rows)]})
    monkeypatch.setattr(segmentation, "segment", lambda l, t, *a, f=segmentation.segment: sizes.append(len(t)) or f(l, t, *a))
    out = pa.Table.from_batches(segmentation._encode(segmentation.MODEL, 2)(iter([batch])))
    assert sum(sizes) == rows and max(sizes) <= segmentation.ROWS
    assert out["doc_id"].to_pylist() == [i for i in range(rows) for _ in range(2)] and all(out["round_trip"].to_pylist())


def test_trie_steps_are_found():
    pieces = segmentation.Pieces.of(segmentation.MODEL)
    node = np.arange(len(pieces.piece))[:4_000]
    for klass in range(0, pieces.classes, 7):
        key = node * pieces.classes + klass
        steps = {k: n for k, n in zip(pieces.keys.tolist(), pieces.next.tolist(), strict=True) if k >= 0} if not klass else steps
        assert pieces.follow(node, np.full(len(node), klass)).tolist() == [steps.get(k, -1) for k in key.tolist()]
    assert len(steps) <= len(pieces.keys) // 4
