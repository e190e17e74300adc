import os
import random
from collections import Counter

import pytest

from lectern.llm import lines, pieces, quality
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_similar import alike

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytestmark = pytest.mark.skipif(not os.path.exists(pieces.default_model()), reason="no vocabulary here")


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    words = "the of and to in is that it was for on are with as his they at be this from reading story child".split()
    sentence = lambda: " ".join(rng.choice(words) + rng.choice(["", "ing", "ed"]) for _ in range(rng.randint(8, 20))) + "."
    rows = []
    for i in range(90):
        text = "\n".join(sentence() for _ in range(rng.randint(2, 5)))
        if i % 6 == 0:
            text = " ".join(w + "$$$ ###" for w in text.split())
        if i % 7 == 3:
            text = rows[-1][1]
        if i % 9 == 4:
            text += "\n" + "shared line that many documents have in common."
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(200, None, "en", "s1", None), (201, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    out, states = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        out = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert out.columns == docs.columns
            states.append({r.doc_id: r.text for r in out.collect()})
    model = quality.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    good = {i: t for i, t, *_ in rows if quality.score(t, model) >= quality.THRESHOLD}
    assert states[0] == good and all((i in good) == (i % 6 > 0) for i in range(90) if i % 7 != 3)  # the others copy the one before
    kept = list(good.items())
    cut = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone) for (i, t), gone in zip(kept, plain_lines(kept, lines.MAX_EDITS), strict=True)}
    assert states[1] == cut
    gone = alike(list(cut.items()))
    assert states[2] == {i: t for i, t in cut.items() if i not in gone}
    assert set(states[3].items()) <= set(states[2].items()) and states[3]
    again = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: Counter((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert key(again) == key(out)
    assert {(r.doc_id, r.text) for r in pieces.decode(out).collect()} == set(states[3].items())
