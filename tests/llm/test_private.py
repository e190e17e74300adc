import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import private

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    digits = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(k, m.group())]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def texts():
    rng = random.Random(11)
    out = [None, "", "a@b", "x a.b+c@d-e.f.g. y", "a@b.c@d.e", "a@b.c_x@d.e@f", "é🙂 me@x.org 漢 1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0255 0000000000000001.2.3.4"]
    out += ["card 4242 4242 4242 4242, 4242-4242-4242-4243 and 4111111111111111. 42", "+1 (415) 555-2671 and +44.20.7946.0958x +1 +123 +1234567890123456", "+1 (208) 555-1177 4284896609045836", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0"]
    out += ["a" * 60_000 + "@", "1" * 60_000, "1." * 30_000, "a@" * 20_000, "+1" * 20_000, "+1" + " " * 50_000, "1 " * 40_000, "a." * 30_000 + "@b.c", " ".join(f"u{i}@mail.org" for i in range(1500))]
    for _ in range(150):
        out.append("".join(rng.choice(["a", "b1", "@", ".", "-", "+", "1", "23", "4242424242424242", " ", "(", ")", "é", "🙂", "x@y.zz", "10.0.0.1", "256", "_", "%", "\n"]) for _ in range(rng.randint(1, 40))))
    return out


def test_base_spans(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts())] + [(None, "me@x.org", 1, "x"), (3, "again@x.org", 1, "x"), (3, "again@x.org", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, row string")
    found = private.report(docs).collect()
    got = sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found)
    want = []
    for i, t, *_ in rows:
        spans = plain(t)
        want.append((str(i), hashlib.sha256(",".join(spans).encode()).hexdigest(), *(sum(s.startswith(k + ":") for s in spans) for k in PLAIN)))
    assert got == sorted(want)
    for r in found:
        if r.doc_id is not None and r.doc_id != 3:
            assert set(plain(rows[r.doc_id][1])) <= set(r.spans.split(",")) | ({""} if not r.spans else set())


def test_votes_add_spans_and_leave_others(spark):
    rng = random.Random(12)
    rows = []
    for i in range(300):
        rows.append((i, f"please call {rng.randint(200, 999)}-555-{rng.randint(1000, 9999)} today" if i % 3 == 0 else f"mail anna{i}@mail.org or +1 (415) 555-{rng.randint(1000, 9999)}" if i % 3 == 1 else f"invoice serial {rng.randint(10**14, 10**15 - 1)}0 of nothing"))
    got = {r.doc_id: r for r in private.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].spans == "phone:12:24" and got[i].n_phone == 0 for i in range(0, 300, 3))
    assert all(got[i].n_email == 1 and got[i].n_phone == 1 for i in range(1, 300, 3))
    assert all(got[i].spans == ",".join(plain(rows[i][1])) for i in range(2, 300, 3))


def test_reliabilities(spark):
    """Against the same expectation-maximisation in numpy, and truth it should find."""
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    rows = {}
    for y in truth:
        v = tuple(int(rng.choice(3, p=(0.2, 0.7, 0.1) if y else (0.2, 0.1, 0.7))) for _ in range(private.LABELERS))
        rows[v] = rows.get(v, 0) + 1
    df = spark.createDataFrame([("email", list(v), n) for v, n in rows.items()], "kind string, v array<int>, n long")
    got = {tuple(r.v): r.posterior for r in private.reliabilities(df).collect()}
    keys = sorted(rows)
    v, n = np.array(keys), np.array([rows[k] for k in keys], float)
    vote0 = np.array([[[0.55, 0.35], [0.1, 0.6], [0.35, 0.05]]] * private.LABELERS)
    vote, prior = vote0.copy(), 0.5

    def soft():
        both = [np.prod([vote[k, v[:, k], y] for k in range(private.LABELERS)], 0) * (prior if y else 1 - prior) for y in (0, 1)]
        return both[1] / (both[0] + both[1])

    for _ in range(private.ROUNDS):
        q = soft()
        prior = (1 + (n * q).sum()) / (2 + n.sum())
        for k in range(private.LABELERS):
            for x in range(3):
                for y in (0, 1):
                    w = n * (q if y else 1 - q)
                    vote[k, x, y] = (vote0[k, x, y] * 10 + w[v[:, k] == x].sum()) / (10 + w.sum())
    assert np.allclose([got[k] for k in keys], soft(), atol=1e-9)
    assert abs(prior - 0.3) < 0.05


def test_empty_and_redaction(spark):
    assert private.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "é me@x.org, 10.0.0.1!"), (2, "nothing")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in private.redact(docs).collect()} == {1: "é <email>, <ip>!", 2: "nothing"}


def test_native(spark):
    df = private.report(spark.createDataFrame([(1, "a@b.cd 555-123-4567")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert df.select(F.count("*")).first()[0] == 1
