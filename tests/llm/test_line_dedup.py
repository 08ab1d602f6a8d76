import random

from frames import clashing, frame, odd_rows, row
from pyspark.sql import functions as F

from ratelens.llm import line_dedup


def brute_force(rows):
    seen, out = set(), []
    order = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = {}
    for key, text in order:
        lines = text.split("\n")
        filled = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for k in range(len(filled) - 2):
            window = tuple(lines[i].strip(" ") for i in filled[k : k + 3])
            if window in seen:
                gone |= set(filled[k : k + 3])
            seen.add(window)
        texts[key, text] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    for r in rows:
        text, n = (None, 0) if r[1] is None else texts[r[0], r[1]]
        out.append((r[0], text, None if text is None else len(text), n))
    return sorted(out, key=repr)


def passages(seed=1):
    rng = random.Random(seed)
    pool = [f"line {i} of the pool" for i in range(60)]
    rows = []
    for key in range(80):
        at = rng.randrange(50)
        lines = [f"own {key} {i}" for i in range(rng.randrange(6))] + pool[at : at + rng.randrange(6)] + ["", "  "] + [f"end {key}"]
        rng.random() < 0.3 and lines.insert(2, "")
        rows.append(row(key, "\n".join(lines)))
    rows += [row(100 + i, "\n".join(["common a", "common b", "common c", "common d", f"x{i}"])) for i in range(50)]
    return rows


def run(docs):
    found = line_dedup.remove_repeated_lines(docs)
    return sorted(((r["doc_id"], r["text"], r["n_chars"], r["removed_lines"]) for r in found.collect()), key=repr)


def test_equals_brute_force(spark):
    rows = passages()
    assert run(frame(spark, rows)) == brute_force(rows)
    assert sum(r[3] for r in brute_force(rows)) > 150


def test_odd_rows(spark):
    rows = [r for r in odd_rows() if not (r[0] == 6)]
    expected = brute_force(rows)
    assert [(a, b) for a, b, _, _ in run(clashing(frame(spark, rows)))] == [(a, b) for a, b, _, _ in expected]


def test_one_text_repeats_itself_and_repeated_rows_are_treated_alike(spark):
    text = "a\nb\nc\nd\na\nb\nc"
    rows = [row(1, text), row(1, text), row(2, "a\nb\nc\nz")]
    assert run(frame(spark, rows)) == [(1, "a\nb\nc\nd", 7, 3), (1, "a\nb\nc\nd", 7, 3), (2, "z", 1, 3)]


def test_empty_table_and_no_length_column(spark):
    docs = frame(spark, passages())
    assert line_dedup.remove_repeated_lines(docs.where(F.lit(False))).count() == 0
    assert line_dedup.remove_repeated_lines(docs.drop("n_chars")).columns == ["doc_id", "text", "lang", "source", "removed_lines"]
