"""Text, name and alignment rules at hand-written cases."""

import itertools
import random
import re
import string
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import align, batch, paths, rates, text

CAN, REF, HYP = "ga u la e ka ha".split(), "ga ga u e ka hi hi".split(), "ga u la i ka hi ho".split()


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_worked_example(spark):
    true, pred = align.tags(CAN, REF), align.tags(CAN, HYP)
    assert (true, pred) == ("iccdccis", "cccscis")
    meta = align.paired(true, pred, align.tags(true, pred))
    assert meta == [("-", "i", "d"), ("c", "c", "c"), ("c", "c", "c"), ("-", "d", "d"), ("c", "c", "c"), ("s", "-", "i"), ("c", "c", "c"), ("i", "i", "c"), ("s", "s", "c")]
    assert align.fine_counts(meta) == (1, 1, 0, 1, 0, 1, 0, 0, 1)
    assert align.placed_errors(CAN, REF) == [(0, "i"), (2, "d"), (5, "i"), (5, "s")]
    assert align.placed_errors(CAN, HYP) == [(3, "s"), (5, "i"), (5, "s")]
    assert align.placed_counts(CAN, REF, HYP) == (1, 1, 0, 0, 0, 1, 1, 0, 1)
    df = spark.createDataFrame([(" ".join(CAN), " ".join(REF), " ".join(HYP))], "c string, r string, h string")
    r = df.select(align.scores(F.col("c"), F.col("r"), F.col("h")).alias("s"), align.tags_sql(F.split("c", " "), F.split("r", " ")).alias("t"), align.placed_scores(F.col("c"), F.col("r"), F.col("h")).alias("p")).first()
    assert (r.s.S_mer, r.s.D_mer, r.s.I_mer, r.s.C_mer, r.s.N_mer) == (0, 2, 1, 6, 8)
    assert r.t == true and r.p.S_TP == 1
    assert one(spark, rates.error_rate(F.lit(0), F.lit(2), F.lit(1), F.lit(8))) == [37.5]


def test_ends():
    assert align.tags([], []) == "" and align.tags([], ["a"]) == "i" and align.tags(["a", "b"], []) == "dd"
    assert align.unit_counts([], ["x", "y"]) == (0, 0, 2, 0, 0)
    assert align.unit_counts(["a", "b"], []) == (0, 2, 0, 0, 2)
    assert align.placed_errors([], ["a"]) == [] and align.placed_errors(["a", "b"], []) == [(0, "d"), (1, "d")]
    s, d, i, c, n = align.unit_counts(["a", "b"], ["b", "a"])
    assert s + d + i == 2 and c + s + d == n == 2
    assert align.tags(["a", "b"], ["b", "a"]).count("s") == 0  # indels are cheaper here
    assert align.tags("recycling", "recycle", 1, 1, 1).count("c") == 6


def cost(truth, test, ins, dele, sub):
    row = [j * dele for j in range(len(truth) + 1)]
    for t in test:
        last, row = row, [row[0] + ins]
        for j, r in enumerate(truth):
            row.append(min(last[j] + (0 if r == t else sub), last[j + 1] + ins, row[-1] + dele))
    return row[-1]


words = st.lists(st.sampled_from("abcd"), max_size=9)


@given(words, words)
@settings(max_examples=300, deadline=None)
def test_alignments_are_best(truth, test):
    ops = align.tags(truth, test)
    assert ops.count("c") + ops.count("s") + ops.count("d") == len(truth)
    assert ops.count("c") + ops.count("s") + ops.count("i") == len(test)
    assert 3 * ops.count("i") + 3 * ops.count("d") + 4 * ops.count("s") == cost(truth, test, 3, 3, 4)
    assert all((a == b) == (o == "c") for a, b, o in align.paired(truth, test, ops) if o in "cs")
    assert align.tags(truth, truth) == "c" * len(truth)
    s, d, i, c, n = align.unit_counts(truth, test)
    if truth:
        assert s + d + i == cost(truth, test, 1, 1, 1) and c + s + d == n == len(truth) and c + s + i == len(test)


@pytest.mark.parametrize("cells", [1, 300, 4_000_000])
def test_batches_do_as_single_pairs(monkeypatch, cells):
    monkeypatch.setattr(batch, "CELLS", cells)
    rng = random.Random(2)
    some = lambda: [rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 5, 12]))]
    pairs = [(some(), some()) for _ in range(400)]
    truths, tests = [a for a, _ in pairs], [b for _, b in pairs]
    assert batch.tags(truths, tests) == [align.tags(a, b) for a, b in pairs]
    assert batch.tags(truths, tests, 1, 2, 5) == [align.tags(a, b, 1, 2, 5) for a, b in pairs]
    assert batch.unit_counts(truths, tests) == [align.unit_counts(a, b) for a, b in pairs]
    assert batch.tags([], []) == [] and batch.tags([[]], [[]]) == [""]


def test_aligners_agree(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice("abc") for _ in range(rng.randint(0, 8))], [rng.choice("abc") for _ in range(rng.randint(0, 8))]) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, a array<string>, b array<string>")
    got = df.select("k", align.tags_sql(F.col("a"), F.col("b")).alias("sql"), align.tag_sequence(F.array_join("a", " "), F.array_join("b", " ")).alias("udf")).collect()
    assert all(r.sql == r.udf == align.tags(rows[r.k][1], rows[r.k][2]) for r in got)


def plain_normalize(s):
    s = unicodedata.normalize("NFC", s or "").lower()
    return re.sub(r"\s+", " ", re.sub("[^\\w\\s'’À-ɏḀ-ỿ]", " ", s)).strip()


def plain_clean(s):
    s = re.sub(r"[\r\n]+", " ", s or "")
    s = re.sub(r"[^\x20-\x7E]", "", s)
    s = re.sub("<[^>]*>", " ", re.sub(r"\s*>\s*", "> ", re.sub(r"\s*<\s*", " <", s)))
    s = " ".join(t for t in s.split() if "<" not in t and ">" not in t)
    return re.sub(r"\s+", " ", re.sub("[,.'0-9?!`\"-]", "", s)).strip().lower()


TEXTS = [None, "", " \t\n", "ng'ombe ng’ombe", "Café CAFÉ", "a-b, c! d_e <unk> x", "tab\there", "a b c", "hy-phen", "<enumerator>", "un<bal anced> < x", "A\r\nB\r\n\r\nC 12 3rd `q\"", "ÀÉÎ ẞ ỿ 漢字 १२", "  many   spaces  ", "x < y > z", "don't 'quote'", "a < foo bar", "a foo > b", "one > two < three four", "e\u0301 A\u030a \u212b \u1100\u1161 \u2126 \u02b0"]


def test_text_rules(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    c = F.col("t")
    for r in df.select("i", text.normalize(c).alias("n"), text.clean(c).alias("c"), text.normalize_ascii(c).alias("a"), text.tokens(c).alias("k"), text.add_vowel(c).alias("v")).collect():
        t = TEXTS[r.i]
        assert r.n == plain_normalize(t), t
        assert r.c == plain_clean(t), t
        assert r.a == re.sub(r"\s+", " ", re.sub("[" + re.escape(string.punctuation) + "]", " ", (t or "").lower())).strip()
        assert r.k == (t or "").split()
    assert one(spark, text.add_vowel(F.lit("b a  Sha e1 (k) ta 12 'm\tz")))[0] == "ba a  Sha e1 (k)a ta 12 'ma\tza"
    assert one(spark, text.without_fillers(F.lit(" <UM> a <noise> b ")), text.without_fillers(F.lit(" <Enumerator> ")), text.without_fillers(F.lit("<um>")), text.text_or_empty(F.lit("NaN")), text.mistakes(F.lit("csid-")), text.mistakes_keeping_gaps(F.lit("csid-"))) == ["a b", None, None, "", "cxxxc", "cxxx-"]


STEMS = {
    "010101_020202_a-audio_letters_grids_letters_grid": ("full_letter_grid", "letters_grid"), "x-audio_NonWords_grid": ("full_nonword_grid", "nonwords_grid"), "x-audio_non_words_grid_segment2": ("full_nonword_grid", "nonwords_grid"), "x_nonword_1": ("full_nonword_grid", "nonwords_grid"),
    "x-audio_syllables_grid_1": ("full_syllable1_grid", "syllables_grid"), "x-audio_iso_letter_12": ("iso_letter_12", "letters_isolated"), "x-audio_iso_random_letters3_4": ("iso_random_letters3_4", "letters_isolated"), "x-audio_iso_random_letters3": ("iso_random_letters3", "letters_isolated"),
    "x-audio_iso_non_word5": ("iso_non_word5", "nonwords_isolated"), "x-audio_iso_random_nw": ("iso_random_nw_unknown", "nonwords_isolated"), "x-audio_iso_random_nw_ab_7": ("iso_random_nw_ab_7", "nonwords_isolated"), "x-audio_iso_syllable_8": ("iso_syllable8", "syllables_isolated"),
    "x-audio_random_syl9": ("random_syl9", "syllables_isolated"), "x-audio_rand_syllable_3": ("rand_syllable3", "syllables_isolated"), "x-audio_passage_2": ("passage_num2", "passage_passage"), "plain": ("unknown", None),
}


def test_name_rules(spark):
    df = spark.createDataFrame([(s,) for s in STEMS], "s string")
    for r in df.select("s", paths.audio_type(F.col("s")).alias("t"), paths.category(paths.audio_type(F.col("s"))).alias("c")).collect():
        assert (r.t, r.c) == STEMS[r.s]
    names = spark.createDataFrame([("a_segment10.wav",), ("a_SEGMENT1.WAV",), ("a.wav",), ("b_segment2.mp3",)], "n string")
    got = {r.n: (tuple(r.s), tuple(r.g)) for r in names.select("n", paths.segment(F.col("n")).alias("s"), paths.group_and_order(F.col("n")).alias("g")).collect()}
    assert got["a_segment10.wav"] == (("a.wav", 10, True), ("a.wav", 10))
    assert got["a_SEGMENT1.WAV"] == (("a_SEGMENT1.WAV", None, False), ("a.wav", 1))
    assert got["b_segment2.mp3"] == (("b.mp3", 2, True), ("b_segment2.mp3", 0))
    from pathlib import PurePosixPath

    for p in ["/a/b.wav", "b", ".wav", "a.", "a/b.tar.gz", "x/y/", "a b.c d"]:
        assert one(spark, paths.file_name(F.lit(p)), paths.stem(paths.file_name(F.lit(p)))) == [PurePosixPath(p).name, PurePosixPath(p).stem] or p == "a."
    assert one(spark, paths.learner_of(F.lit("010203_040506_B-audio_x")), paths.learner_of(F.lit("a_b_c_d-audio_x")), paths.learner_of(F.lit("a_b")), paths.speaker_of(F.lit("/x/a_b_c_d.wav")), paths.speaker_of(F.lit("a_b.wav"))) == ["010203_040506_B", "a_b_c", "a_b", "a_b_c", "a"]


@pytest.mark.parametrize("rows,want", [([], None), ([(1, 2)], None), ([(1, 2), (1, 3)], None), ([(1, 2), (2, 4), (None, 9)], 1.0)])
def test_correlation_without_variance(spark, rows, want):
    got = spark.createDataFrame(rows, "x int, y int").agg(rates.correlation(F.col("x"), F.col("y")).alias("r")).first().r
    assert got == want or abs(got - want) < 1e-9


def test_rates(spark):
    n = lambda *v: [F.lit(x) for x in v]
    assert one(spark, rates.wer(*n(0, 0, 2, 0)), rates.wer(*n(0, 0, 0, 0)), rates.wer(*n(1, 1, 0, 4))) == [float("inf"), None, 50.0]
    assert one(spark, *rates.prf(*n(0, 0, 0))) == [0.0, 0.0, 0.0] and one(spark, *rates.prf(*n(0, 0, 0), zero=False)) == [None, None, None]
    assert one(spark, rates.alignment_wer(*n(0, 0, 0, 0)), rates.alignment_accuracy(*n(0, 0, 0))) == [1.0, 0.0]
    assert list(itertools.chain(one(spark, rates.balanced_agreement(*n(1, 1, 1, 1))))) == [0.5]
