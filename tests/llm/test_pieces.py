import hashlib
import os
import random

import numpy as np
import pytest

from lectern.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.default_model()), reason="no vocabulary here")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.default_model())


def texts():
    rng = random.Random(4)
    out = ["", " ", "a", " a  b ", "Hello world", "\n\t x\r\n", "naïve 漢字 🙂 ▁ ▁▁x", "<s> </s> <0x0A> <unk>", "x" * 5000, " " * 300, "é" * 40, "\x00\x7f"]
    for _ in range(150):
        out.append("".join(rng.choice("abcdehinorst  \nÜß.,!?1▁🙂") for _ in range(rng.randint(1, 120))))
    return out


def plain_merge(v, word):
    """All candidates anew after each merge."""
    sym = list(word)
    while True:
        best = min(((-v.score[sym[i] + sym[i + 1]], sum(map(len, sym[:i])), i) for i in range(len(sym) - 1) if sym[i] + sym[i + 1] in v.score), default=None)
        if best is None:
            return sym
        i = best[2]
        sym[i : i + 2] = [sym[i] + sym[i + 1]]


def test_without_dropout(vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for t in texts():
        if "▁" not in t:
            assert vocabulary.encode(t).tolist() == sp.encode(t), t
    for w in ["▁internationalisation", "▁ththereonand", "▁▁▁▁x", "aaaaaaaaa"]:
        assert vocabulary.merge(w)[0] == plain_merge(vocabulary, w)


MASK = 2**64 - 1


def plain_stir(x):
    x = (x ^ x >> 32) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 29) * 0x94D049BB133111EB & MASK
    return x ^ x >> 32


def plain_encode(v, text, seed, key, rate):
    """Every part from the text as a whole, all candidates anew after each step, each chance by itself."""
    parts = []
    for k, some in enumerate(text.split("▁")):
        if k:
            parts.append(None)
        chars = ("" if k else "▁") + some.replace(" ", "▁")
        for i, c in enumerate(chars):
            if i and chars[i - 1] + c in v.pairs:
                parts[-1] += c
            else:
                parts.append(c)
    out = []
    for place, part in enumerate(parts):
        if part is None:
            out += [v.byte[x] for x in "▁".encode()]
            continue
        h = plain_stir(plain_stir((key ^ seed * 0x9E3779B97F4A7C15) & MASK) + place * 0x9E3779B97F4A7C15 & MASK)
        sym, passed, k = [(i, i + 1) for i in range(len(part))], set(), 0
        spell = lambda s, part=part: part[s[0] : s[1]]
        while True:
            fit = [(-v.score[spell(a) + spell(b)], v.id[spell(a) + spell(b)], i) for i, (a, b) in enumerate(zip(sym, sym[1:])) if spell(a) + spell(b) in v.score and (a, b) not in passed]
            if not fit:
                break
            i = min(fit)[2]
            if plain_stir(h + (k + 1) * 0x9E3779B97F4A7C15 & MASK) >> 11 < rate * 2**53:
                passed.add((sym[i], sym[i + 1]))
            else:
                sym[i : i + 2] = [(sym[i][0], sym[i + 1][1])]
            k += 1
        for s in map(spell, sym):
            out += [v.id[s]] if s in v.id else [v.byte[x] for x in s.encode("utf-8")]
    return out


@pytest.mark.parametrize("short,branches", [(32, 20), (0, 20), (4, 2)])
def test_dropout_against_brute_force(vocabulary, monkeypatch, short, branches):
    monkeypatch.setattr(pieces, "SHORT", short)  # neither the agenda's form nor what is remembered may matter
    monkeypatch.setattr(pieces, "BRANCHES", branches)
    v = pieces.Vocabulary(pieces.default_model())
    some = [t for t in texts() if len(t) < 400] + ["thornandered internationalisation " * 9, "xyz" * 30 + " " + "theinand" * 12]
    for rate in (0.1, 0.5, 1.0):
        keys = np.arange(-5, len(some) - 5)
        ids, ends = v.encode_all(some, keys, 7, rate)
        for t, key, own in zip(some, keys.tolist(), np.split(ids, ends[:-1]), strict=True):
            assert own.tolist() == (plain_encode(v, t, 7, key, rate) if t else []), (rate, t)
            assert v.decode(own) == t


def test_every_occurrence_has_its_own_chances(vocabulary):
    ids, ends = vocabulary.encode_all(["internationalisation " * 300] * 2, np.array([1, 2], np.int64), 42, 0.1)
    cut = [len({tuple(x) for x in np.split(own, np.flatnonzero(own[1:] == vocabulary.id["▁"]) + 1)}) for own in np.split(ids, ends[:-1])]
    assert min(cut) > 5 and not np.array_equal(*np.split(ids, ends[:-1])[:2])
    assert np.array_equal(ids, pieces.Vocabulary(pieces.default_model()).encode_all(["internationalisation " * 300] * 2, np.array([1, 2], np.int64), 42, 0.1)[0])


def test_long_parts(vocabulary):
    w = "x" + "ab" * 600_000  # one part of over 2 ** 20 characters
    pieces_, n = vocabulary.merge(w)
    assert "".join(pieces_) == w and n >= len(pieces_) - 1
    assert pieces_[:400] == vocabulary.merge(w[:2000])[0][:400]
    assert vocabulary.decode(vocabulary.encode(w, 1, 2, 0.2)) == w


@pytest.mark.parametrize("rate", [0.1, 0.5])
def test_skips_come_at_the_rate(vocabulary, rate):
    for word in ("he", "in", "re"):  # a merge of its own after each newline
        ids = vocabulary.encode("\n".join([word] * 3000), 3, 9, rate)
        assert abs(np.mean(ids[ids != vocabulary.byte[10]][3:] == vocabulary.id[word]) - (1 - rate) / (1 + rate)) < 0.06


def test_frames(spark, vocabulary):
    rows = [(i, t, 0, "x") for i, t in enumerate(texts())] + [(None, "no id", 0, "x"), (900, None, 1, "x"), (900, "same id", 1, "x"), (901, "long text " * 50_000, 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, stream string")
    e = pieces.encode(docs)
    assert e.columns == ["doc_id", "ids"] and e.count() == len(rows)
    back = sorted(((r.doc_id, r.text) for r in pieces.decode(e).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t, _, _ in rows), key=str)
    got = {(r.doc_id, r.n_ids): r for r in pieces.checked(docs.repartition(7)).collect()}  # in another order, in other batches
    assert all(r.lossless for r in got.values())
    for r in e.collect():
        x = np.array(r.ids, "<i4")
        assert got[r.doc_id, len(x)].ids_sha256 == hashlib.sha256(x.tobytes()).hexdigest()
    assert pieces.encode(docs.limit(0)).count() == 0
