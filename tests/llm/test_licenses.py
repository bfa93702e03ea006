import re

import pytest

from loomfact.llm import licenses

from .frames import edge_docs, empty_docs, passage


def words(text):
    return [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]


def shingles(text):
    w = words(text)
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def test_planted_notices(spark):
    names = sorted(licenses.TEMPLATES)
    rows, want = [], set()
    for i, name in enumerate(names * 6):
        notice = licenses.TEMPLATES[name]
        if i >= 3 * len(names) and len(words(notice)) > 40:
            notice = notice.replace("software", "program", 1)
        rows.append((i, f"{passage(i, i * 7 % 50)} {notice.upper() if i % 2 else notice} {passage(i + 1, 40)}"))
        have = shingles(rows[-1][1])
        want |= {(i, n) for n in names if len(shingles(licenses.TEMPLATES[n]) & have) >= 0.8 * len(shingles(licenses.TEMPLATES[n]))}
    got = {(r.id, r.template) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and {n for _, n in got} >= set(names) - {"never"}


def inserted(text, n, at):
    w = text.split()
    return " ".join([*w[: int(at * len(w))], *(f"new{i}" for i in range(n)), *w[int(at * len(w)) :]])


def test_words_in_between(spark):
    rows = [(k, passage(k, 30) + " " + inserted(licenses.TEMPLATES[name], n, at) + " " + passage(k + 1, 30)) for k, (name, n, at) in enumerate([(name, n, at) for name in ("mit", "apache-notice", "gpl-notice", "bsd-conditions") for n in (20, 40) for at in (0.3, 0.5)])]
    want = set()
    for i, text in rows:
        want |= {(i, n) for n, t in licenses.TEMPLATES.items() if len(shingles(t) & shingles(text)) >= 0.8 * len(shingles(t))}
    got = {(r.id, r.template) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and len(want) >= len(rows)


def test_every_place_of_a_template(spark):
    notice, line = licenses.TEMPLATES["gpl-notice"], licenses.TEMPLATES["apache-line"]
    text = " ".join(f"{passage(k, 150)} {notice} {passage(k + 50, 150)} {line}" for k in range(6))
    got = licenses.scan(spark.createDataFrame([(1, text), (1, text)], "doc_id bigint, text string")).collect()
    for name in ("gpl-notice", "apache-line"):
        own = sorted(r.start_word for r in got if r.template == name)
        assert len(own) == 12 and len(set(own)) == 6 and all(r.containment == 1 for r in got if r.template == name)
        at = [k for k in range(len(words(text))) if words(text)[k : k + 5] == words(licenses.TEMPLATES[name])[:5]]
        assert all(0 <= a - b <= 30 for a, b in zip(at, sorted(set(own))))


def test_clean_documents(spark):
    assert licenses.scan(edge_docs(spark)).count() == 0
    assert licenses.scan(empty_docs(spark)).count() == 0


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (2, "one two three four")], "doc_id bigint, text string")
    got = licenses.scan(docs, {"count": "One two three four five."}).collect()
    assert [(r.id, r.template, r.containment) for r in got] == [(1, "count", 1.0)]
    assert licenses.scan(docs, {"short": "one two"}).count() == 0 and licenses.scan(docs, {}).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, {"long": "word " * 1_000_000})


def test_main_path_is_native(spark):
    plan = licenses.scan(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
