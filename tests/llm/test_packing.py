import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from foldstore.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's <|endoftext|> we'll  x ÀÉ İΣ 12a_b ١٢ 你好 don't''s", "", "  ", "a\x1cb", "ﬁ Ⅷ ²³ ªº x_y--z", "É é", "ß Œ ŉ ǅ ab'll12'S ­ x", "'s 's'S 've-- …—“a”", "Straße\r\n\tZwei"]


def test_ids_equal_the_tokenizer(corpus):
    whole, mine = Tokenizer.from_file(PATH), P.tokenizer(PATH)
    for t in ODD + [r.text for r in corpus.select("text").collect() if r.text]:
        assert mine(t) == np.asarray(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:50]


def test_known_words_are_forgotten_by_generations(monkeypatch):
    monkeypatch.setattr(P, "CACHE", 50)
    mine, whole, r = P.WordTokenizer(PATH), Tokenizer.from_file(PATH), random.Random(1)
    for _ in range(60):
        t = " ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(r.choice([3, 30, 200])))
        assert mine(t) == np.asarray(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(mine.young) <= 400


def test_best_fit_takes_the_fullest_bin():
    r = random.Random(2)
    for _ in range(30):
        size = [r.randint(1, 60) for _ in range(40)]
        rooms, bins = [], []
        for i in sorted(range(40), key=lambda i: (-size[i], i)):
            fits = [(rooms[k], k) for k in range(len(bins)) if rooms[k] >= size[i]]
            if fits:
                room = min(fits)[0]
                k = next(k for k in range(len(bins)) if rooms[k] == room)
                bins[k].append(i)
                rooms[k] -= size[i]
            else:
                bins.append([i])
                rooms.append(60 - size[i])
        got = P.best_fit(size, 60)
        assert len(got) == len(bins) and sorted(sum(got, [])) == list(range(40)) and all(sum(size[i] for i in b) <= 60 for b in got)


def test_local_search_empties_bins():
    # 6+4 and 5+5 fill bins of 10; the start wastes one bin.
    size = [6, 5, 5, 4, 3, 3, 4, 2, 2, 6]
    start = [[0, 4], [1, 6], [2, 5], [9, 7], [3], [8]]
    got = P.local_search([list(b) for b in start], size, 10)
    assert sorted(sum(got, [])) == list(range(10)) and all(sum(size[i] for i in b) <= 10 for b in got)
    square = lambda bins: sum(sum(size[i] for i in b) ** 2 for b in bins)
    assert square(got) > square(start) and len(got) < len(start)


def test_local_search_mends_best_fit_in_a_full_block():
    r = random.Random(1)
    size = [r.randint(300, 900) for _ in range(P.BLOCK)]
    first = P.best_fit(size, P.CAPACITY)
    got = P.local_search([list(b) for b in first], size, P.CAPACITY)
    assert sorted(sum(got, [])) == list(range(P.BLOCK)) and all(sum(size[i] for i in b) <= P.CAPACITY for b in got)
    least = -(-sum(size) // P.CAPACITY)
    assert len(first) > least + 60 and len(got) < len(first) - 40


def test_bins_of_many_pieces_take_part():
    # 100 pieces of 3 leave a room of 20, which a piece of 50 for ten of them, step by step, or a 20 fills.
    size = [3] * 100 + [20, 150] + [1] * 60
    start = [list(range(100)), [100, 101], list(range(102, 162))]
    got = P.local_search([list(b) for b in start], size, 320)
    assert sorted(sum(got, [])) == list(range(len(size))) and 320 in [sum(size[i] for i in b) for b in got] and len(got) == 2


def test_best_steps_against_all_of_them():
    """The step that the index finds gains as much as the best of all moves and exchanges that raise the sum of squares."""
    r = random.Random(4)
    for _ in range(60):
        size = [r.randint(1, 30) for _ in range(24)]
        bins = [[], [], [], [], [], []]
        for i in r.sample(range(24), 24):
            k = r.choice([k for k in range(6) if sum(size[x] for x in bins[k]) + size[i] <= 100])
            bins[k].append(i)
        u = P.Underfull(bins, size, 100)
        for k in range(6):
            fill = u.fill
            if not 0 < fill[k] < 100:
                continue
            sums = lambda b: [(0, 0)] + [(size[i], 1) for i in b] + [(size[i] + size[j], 2) for x, i in enumerate(b) for j in b[x + 1 :]]
            best = max((n - m for a in range(6) if a != k and 0 < fill[a] < 100 for n, x in sums(bins[a]) for m, y in sums(bins[k]) if x and x + y < 4 and 0 < n - m <= 100 - fill[k] and n - m > fill[a] - fill[k]), default=0)
            got = u.best(k)
            assert (got[0] if got else 0) == best
            if got:
                assert sum(got[2]) - sum(got[3]) == best


def test_pieces_and_places(spark, corpus):
    whole = Tokenizer.from_file(PATH)
    want = sorted((r.doc_id, len(ids := [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]), zlib.crc32(np.asarray(ids, "<u4").tobytes())) for r in corpus.where("doc_id is not null").select("doc_id", "text").collect())
    rows = P.pack(corpus.select("doc_id", "text"), PATH, block=64).collect()
    ids, seqs = {}, {}
    for r in rows:
        ids.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    for doc, n, crc in want:
        mine = sorted(ids[doc], key=lambda r: r.piece)
        if n <= 2048:
            assert {(r.piece, r.start, r.length, r.ids_crc32) for r in mine} == {(0, 0, n, crc)}
        else:
            assert [(r.piece, r.start, r.length) for r in mine] == [(k, 2048 * k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048))]
    total = sum(r.length for r in rows)
    assert sum(1 for r in rows if r.doc_id == 7) == 2 and len(seqs) <= -(-total // 2048) + 2
    assert P.pack(corpus.limit(0).select("doc_id", "text"), PATH).count() == 0


def test_repeated_rows_go_to_several_blocks(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h")] * 500, "doc_id long, text string").repartition(4)
    rows = P.pack(df, PATH, block=64).collect()
    assert len(rows) == 500 and len({r.sequence_id >> 32 for r in rows}) > 3
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(places) == 500
