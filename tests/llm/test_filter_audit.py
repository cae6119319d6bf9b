"""Operator 12 against a plain evaluation of every document in every order."""

from itertools import permutations

from graphloom.llm.filter_audit import filter_audit, interaction_audit

LONG = " ".join(f"word{k}" for k in range(120))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, None), (4, "short", "en"), (5, "SHORT # one", "de"), (6, None, None), (7, "", "de"), (8, "a b " * 80, "en"), (9, "A" * 50, ""), (4, "short", "en"), (None, LONG, "en"), (None, LONG, "en"),
    (10, LONG + " $", "en"), (11, "x\x0by\tz\rq", "de"), (12, "É" * 200, "fr"), (13, "w " * 60_000, "fr"), (14, "short", "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (4, 1, None), (8, None, 1), (99, 1, 1), (None, 1, 1)]


def plain(rows, labels):
    def mask(doc_id, text):
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        own = (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) << 2 | any(c in "#$%&*|" for c in text) << 3
        return own | (doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows)) << 4

    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    docs, out = [(lang or "", mask(d, t), d in good and d is not None, d in toxic and d is not None) for d, t, lang in rows], {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, c in enumerate(order, 1):
                bit = 1 << "ABCDE".index(c)
                gone = [d for d in left if d[1] & bit]
                failing = [d for d in docs if d[0] == part and d[1] & bit]
                left = [d for d in left if not d[1] & bit]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == bit for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    shapley = {}
    for (part, order, step), x in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + x[1]
    return {(p, o, s): (*x, shapley[p, o[s - 1]]) for (p, o, s), x in out.items()}


def test_equals_a_plain_run_of_every_order(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").selectExpr("*", "1 as n", "'clash' as mask", "2 as quality")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "'clash' as part")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit(docs, labels).collect()}
    assert got == plain(ROWS, LABELS)
    assert filter_audit(docs.limit(0), labels).count() == 0
    none = {(r.part, r.filter_order, r.step): r.good_lost + r.toxic_lost for r in filter_audit(docs, labels.limit(0)).collect()}
    assert none.keys() == got.keys() and not any(none.values())


def test_other_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 4, 2, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in interaction_audit(cells, "XY").collect()}
    assert got == {("XY", 1): (5, 4, 0, 4), ("XY", 2): (5, 0, 4, 4), ("YX", 1): (5, 4, 0, 4), ("YX", 2): (5, 0, 4, 4)}
