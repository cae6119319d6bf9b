"""The worker's cache of pre-tokens: bounded, and what is asked for again and again stays."""

import random

from graphloom.llm import pretokens
from graphloom.llm.pretokens import CACHE_ROWS, ODD, PIECES, PackedIds, Pretokens, cut_together, packed, tokenizer_path


def test_cache_is_small_and_keeps_what_is_asked_for():
    made = []
    cache = Pretokens(tokenizer_path(), lambda ids: made.append(1) or packed(ids), 64)
    for k in range(2000):
        assert cache[" often"] == packed(cache.ids(" often")) and cache[f" w{k}"] == packed(cache.piece_ids(f" w{k}"))
        assert len(cache) + len(cache.older) <= 64 + 2
    assert len(made) == 2001
    assert CACHE_ROWS * 170 <= 32 << 20


def test_texts_cut_together_have_the_pieces_of_the_pattern():
    rng = random.Random(5)
    alphabet = ["'", "'s", "'re", "'ll", "'v", "'l", "s", "t", "e", "A", "é", "ß", "中", "7", "٣", "_", "!", "…", " ", "  ", "\n", "\t", " ", "\r\n", "\x1c", "😀", "½"]
    texts = ["".join(rng.choices(alphabet[: rng.choice([24, 24, 27])], k=rng.randrange(12))) for _ in range(30_000)]
    texts += ["", "a", " ", "'", "'s", "x'", "x'r", "'", "l", "'l", "l", "'", "re", "a ", " b", "\n", "b", "'sorry 'tis !'s it''s\n's I'd've"]
    for part in [texts, texts[::-1], [], [""], ["", ""], ["\x1c"], ["'"], ["'l"]]:
        pieces, bounds, odd = cut_together(part)
        pieces, bounds = pieces.to_pylist(), bounds.tolist()
        assert odd.tolist() == [bool(ODD.search(x)) for x in part] and len(bounds) == len(part) + 1
        assert [pieces[a:b] for a, b in zip(bounds, bounds[1:])] == [[] if o else PIECES.findall(x) for x, o in zip(part, odd)]


def test_packed_ids_are_the_tokenizer_s_and_each_distinct_pre_token_is_looked_up_once(monkeypatch):
    cache, made = PackedIds(tokenizer_path(), spelt_rows=64), []
    texts = ["", "Ça va, l'été?", "two  words\n", "x😀y", f"a {cache.marks[0]} b", "don't we're! " * 9, " ", "", "!", "w" * 90, "\x00 中文"]
    rng = random.Random(6)
    texts += [" ".join("".join(rng.choices("abehiprst", k=rng.randrange(1, 9))) for _ in range(60)) for _ in range(20)]  # far more words than rows
    for size in (1 << 20, 400, 8):
        monkeypatch.setattr(pretokens, "GROUP_CHARS", size)
        for _ in range(2):
            assert list(cache.of_texts(texts)) == [packed(cache.ids(x)) for x in texts]
    monkeypatch.setattr(pretokens, "GROUP_CHARS", 1 << 20)
    cache, once = PackedIds(tokenizer_path()), Pretokens.piece_ids
    monkeypatch.setattr(Pretokens, "piece_ids", lambda self, piece: made.append(piece) or once(self, piece))
    words = [f"again and w{k}" for k in range(3000)]
    for part in (words, words[::-1]):
        assert list(cache.of_texts(part)) == [packed(cache.ids(x)) for x in part]
    assert len(made) <= 3020 and cache.spelt.nbytes <= 32 << 20  # none of the second time, but for rows that two pre-tokens share
