"""Keys, types and categories read from file names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def stem(name: Column) -> Column:
    """A file name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(name, "(?<=.)\\.[^.]+$", "")


def with_audio_keys(df: DataFrame, path_col: str = "audio_file") -> DataFrame:
    """``df`` with audio_path_csv, audio_name and audio_stem."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    return df.withColumns({"audio_path_csv": path, "audio_name": file_name(path), "audio_stem": stem(file_name(path))})


def _first_parts(base: Column, otherwise: Column) -> Column:
    parts = F.split(base, "_", -1)
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 3), "_")).otherwise(otherwise)


def learner_of(audio_stem: Column) -> Column:
    """What stands before ``-audio``: a dated id whole, else its first three parts."""
    base = F.substring_index(audio_stem, "-audio", 1)
    return F.when(base.rlike("^\\d{6}_\\d{6}_[A-Za-z]$"), base).otherwise(_first_parts(base, base))


def speaker_of(path: Column) -> Column:
    """The first three parts of a recording's stem, or its first part."""
    s = stem(file_name(path))
    return _first_parts(s, F.substring_index(s, "_", 1))


def audio_type(audio_stem: Column) -> Column:
    """The item type a file name tells of; the first rule that applies decides."""
    source = F.when(F.instr(audio_stem, "-audio_") > 0, F.regexp_replace(audio_stem, "^.*?-audio_", "")).otherwise(audio_stem)
    s = F.lower(F.regexp_replace(source, "_segment\\d+$", ""))

    def numbered(out: Column, pattern: str, prefix: str, name: str | None = None, second: bool = False) -> Column:
        first = F.regexp_extract(s, pattern, 1)
        value = F.when(first == "", F.lit(name)).otherwise(first) if name else first
        if second:
            last = F.regexp_extract(s, pattern, 2)
            value = F.concat(value, F.when(last == "", "").otherwise(F.concat(F.lit("_"), last)))
        return out.when(s.rlike(pattern), F.concat(F.lit(prefix), value))

    out = F.when(s.contains("letters_grid"), "full_letter_grid")
    out = out.when(s.contains("non_words_grid") | s.contains("nonword"), "full_nonword_grid")
    out = out.when(s.contains("syllables_grid"), "full_syllable1_grid")
    out = numbered(out, "iso_letter_(\\d+)", "iso_letter_")
    out = numbered(out, "iso_random_letters(\\d+)(?:_(\\d+))?", "iso_random_letters", second=True)
    out = numbered(out, "iso_non_word_?(\\d+)", "iso_non_word")
    out = numbered(out, "iso_random_nw(?:_([a-z0-9]+))?(?:_(\\d+))?", "iso_random_nw_", "unknown", True)
    out = numbered(out, "iso_syllable_?(\\d+)", "iso_syllable")
    out = numbered(out, "random_syl_?(\\d+)", "random_syl")
    out = numbered(out, "rand_syllable_?(\\d+)", "rand_syllable")
    out = numbered(out, "passage_?(\\d+)", "passage_num")
    return out.otherwise("unknown")


#: Report categories in their order.
CATEGORIES = ("passage_passage", "syllables_grid", "nonwords_grid", "letters_grid", "syllables_isolated", "nonwords_isolated", "letters_isolated")


def category(item_type: Column) -> Column:
    """One of CATEGORIES; null for a type that belongs to none, so that the row can be set aside."""
    any_of = lambda *names: F.regexp_like(item_type, F.lit("|".join(names)))
    return (
        F.when(any_of("iso_letter", "iso_random_letters"), "letters_isolated")
        .when(any_of("letters_grid", "letter_grid"), "letters_grid")
        .when(any_of("iso_non_word", "iso_random_nw"), "nonwords_isolated")
        .when(any_of("non_words_grid", "non_word_grid", "nonword_grid"), "nonwords_grid")
        .when(any_of("iso_syllable", "random_syl", "rand_syllable"), "syllables_isolated")
        .when(any_of("syllables_grid", "full_syllable"), "syllables_grid")
        .when(any_of("passage"), "passage_passage")
    )


def macro_and_sub(item_type: Column) -> Column:
    """struct(macro, sub) of the older categories, where random items are a kind of their own; nulls for others."""
    t = F.lower(item_type)
    rules = [
        (t == "full_letter_grid", "letters", "grid"),
        (t.startswith("iso_letter_"), "letters", "isolated"),
        (t.startswith("iso_random_letters"), "letters", "random"),
        (t.startswith("full_syllable"), "syllables", "grid"),
        (t.startswith("iso_syllable"), "syllables", "isolated"),
        (t.startswith("rand_syllable") | t.startswith("random_syl"), "syllables", "random"),
        (t.startswith("full_nonword"), "nonwords", "grid"),
        (t.startswith("iso_non_word"), "nonwords", "isolated"),
        (t.startswith("iso_random_nw"), "nonwords", "random"),
        (t.startswith("passage_num"), "passage", "passage"),
    ]
    macro = F.coalesce(*[F.when(test, m) for test, m, _ in rules])
    sub = F.coalesce(*[F.when(test, x) for test, _, x in rules])
    return F.struct(macro.alias("macro"), sub.alias("sub"))


def segment(name: Column) -> Column:
    """struct(base, number, is_segment) of ``..._segment<n>.<ext>``; others are their own base, with a null number."""
    number = F.regexp_extract(name, "_segment(\\d+)(\\.[^.]+)$", 1)
    found = number != ""
    base = F.when(found, F.regexp_replace(name, "_segment\\d+(\\.[^.]+)$", "$1")).otherwise(name)
    return F.struct(base.alias("base"), F.when(found, number.cast("long")).alias("number"), found.alias("is_segment"))


def group_and_order(name: Column) -> Column:
    """struct(group, order) of the older rule: ``.wav`` only, in any case; others have order 0."""
    number = F.regexp_extract(name, "(?i)_segment(\\d+)\\.wav$", 1)
    group = F.when(number != "", F.regexp_replace(name, "(?i)_segment\\d+\\.wav$", ".wav")).otherwise(name)
    return F.struct(group.alias("group"), F.when(number != "", number.cast("long")).otherwise(0).alias("order"))


def under_prefix(path: Column, root: str, prefix: str | None) -> Column:
    """A path below ``root`` moved below ``prefix``; others, and all without a prefix, as they are."""
    if not prefix:
        return path
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.concat(F.lit(prefix.rstrip("/") + "/"), F.substring(path, len(root) + 1, 1 << 20))).otherwise(path)


def below(root: str, *parts: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), *parts)


def segment_path(root: str, speaker: Column, audio_stem: Column, number: Column, ext: str = ".wav") -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), speaker, F.lit("/"), audio_stem, F.lit("_segment"), number.cast("string"), F.lit(ext))


def path_order(path: Column) -> Column:
    """Sorts paths part by part, as a file listing does."""
    return F.split(path, "/", -1)
