"""Line dedup against all pairs of lines."""

import random

from placewright.llm import line_dedup as L

SCHEMA = "doc_id long, text string, n_chars long, pos int, line string, at long"


def within_one(a: str, b: str) -> bool:
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows, near_from=20):
    places = sorted((d, i, line) for d, t in rows for i, line in enumerate((t or "").split("\n")) if line.strip())
    gone = set()
    for k, (d, i, line) in enumerate(places):
        if any(a == line or (len(line) >= near_from and within_one(a, line)) for *_, a in places[:k]):
            gone.add((d, i))
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def made(seed):
    rng = random.Random(seed)
    words = ["a", "bé", "road", "the", "house", "1890", "x-y", "漢字", "end."]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(60)] + ["", " ", "x" * 40, "=" * 30, "q" * 999, "q" * 1000]
    for _ in range(140):
        s = list(rng.choice(lines))
        for _ in range(rng.choice([0, 1, 1, 2])):
            p, kind = rng.randint(0, len(s)), rng.randrange(3)
            if kind == 0:
                s.insert(p, rng.choice("a 1.é"))
            elif p < len(s) and kind == 1:
                del s[p]
            elif p < len(s):
                s[p] = rng.choice("b 2.")
        lines.append("".join(s))
    rng.shuffle(lines)
    rows, i = [(500, None), (501, "")], 0
    while i < len(lines):
        n = rng.randint(1, 6)
        rows.append((len(rows) * 7 % 401, "\n".join(lines[i : i + n])))
        i += n
    return rows


def test_equals_all_pairs(spark):
    for seed in (1, 2):
        rows = made(seed)
        docs = spark.createDataFrame([(d, t, None if t is None else len(t), 1, "clash", 2) for d, t in rows], SCHEMA)
        got = {r["doc_id"]: r for r in L.dedup_lines(docs).collect()}
        want = brute(rows)
        assert {d: r["text"] for d, r in got.items()} == want
        assert all(r["n_chars"] == (None if want[d] is None else len(want[d])) and r["line"] == "clash" for d, r in got.items())


def test_no_python_in_the_plan(spark, capsys):
    docs = spark.createDataFrame([(1, "a line that is long enough\nb", 3, 1, "", 1)], SCHEMA)
    L.dedup_lines(docs).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Arrow", "Pandas"))


def test_empty_table_and_report(spark):
    docs = spark.createDataFrame([(1, "same line\nother", 3, 1, "", 1), (2, "same line\n\nthird", 3, 1, "", 1), (None, "same line", 3, 1, "", 1)], SCHEMA)
    assert L.dedup_lines(docs.limit(0)).count() == 0
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in L.report(docs).collect()}
    assert got == {1: (2, 0), 2: (2, 1), None: (1, 0)}


def test_long_stretches(spark):
    rng = random.Random(5)
    lines = []
    for signs, n in (("道路家園年海上外灘路", 3000), ("กขคงจฉชซ", 1001), ("abcdef", 1000), ("x", 1500), ("abcdef", 1001)):
        source = "".join(rng.choice(signs) for _ in range(n))
        for at in (0, n // 2, n - 1):
            lines += [source[:at] + "z" + source[at:], source[:at] + " " + source[at:], source[:at] + source[at + 1 :], source[:at] + "7" + source[at + 1 :]]
        lines += [source, source[: n // 3] + "zz" + source[n // 3 :], source + "tail"]
    rng.shuffle(lines)
    docs = [(k, "\n".join(x), 1, 1, "", 1) for k, x in enumerate([lines[::2], lines[1::2]])]
    got = {(r["doc_id"], r["pos"]) for r in L.repeated_lines(spark.createDataFrame(docs, SCHEMA)).collect()}
    places = [(d, i, x) for d, text, *_ in docs for i, x in enumerate(text.split("\n"))]
    want = {(d, i) for k, (d, i, x) in enumerate(places) if any(a == x or within_one(a, x) for *_, a in places[:k])}
    assert got == want
