"""Every query of the package equals its SQL or a brute-force version on the smallest tables."""

import html
import re

import pytest

import corpus_pipeline
from tests.oracle import difference, duck, duck_table, spark_table
from tidemill.llm import queries as q
from tidemill.llm.helpers import marked_words

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_sql(spark, con, name):
    assert difference(spark_table(q.QUERIES[name](spark, FOLDER)), duck_table(con, q.ORACLES[name])) is None


def test_quality_held_out(spark, con):
    rows = {r.doc_id: r for r in q.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = duck("/root/testdata/sf0.01").sql("SELECT doc_id, quality FROM labels").fetchall()
    held = [(rows[i].predicted, quality) for i, quality in labels if rows[i].held_out]
    assert len(rows) == 1000 and len(held) > 40
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_html_against_plain_slicing(spark, con):
    pages = dict(con.sql("SELECT page_id, html FROM pages").fetchall())
    for row in q.op5_html_extraction(spark, FOLDER).collect():
        article = re.search(r"<article>(.*)</article>", pages[row.page_id], re.S).group(1)
        blocks = [re.sub(r"</?b>", "", b).replace("<br>", " ") for b in re.split(r"</?(?:p|h1)>", article)]
        wanted = "\n".join(x for b in blocks if (x := re.sub(r"\s+", " ", html.unescape(b)).strip()))
        assert row.text == wanted and row.n_chars == len(wanted)


def test_url_rules_and_verdicts(spark, con):
    urls = dict(con.sql("SELECT page_id, url FROM pages").fetchall())
    for row in q.op6_url_filter(spark, FOLDER).collect():
        rest = urls[row.page_id].split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        fits = [(len(t), t, v) for v, t in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
                if f".{host}".endswith("." + t.split("/", 1)[0]) and path.startswith("/" + t.split("/", 1)[1])]
        assert (row.host, row.path) == (host.lower(), path)
        if fits:
            assert (row.rule, row.verdict) == max(fits)[1:]
        else:
            bad = re.search(r"casino|bets|pills|spam|adult|ads", host)
            assert row.rule is None and row.verdict == ("block" if bad else "allow")


def test_license_places(spark, con):
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for row in q.op8_license_scan(spark, FOLDER).collect():
        words = [w.decode() for w in marked_words((texts[row.doc_id] or "").encode())]
        found = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        base = {label for _, label in found}
        assert (row.n_words, row.n_base) == (len(words), len(found))
        assert row.base_labels == ",".join(sorted(base)) and base <= set(row.labels.split(",")) | {""}
        assert (row.first_word, row.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))


def test_mixing_totals(spark, con):
    rows = q.op10_mixing(spark, "/root/testdata/sf0.01").collect()
    sources = dict(duck("/root/testdata/sf0.01").sql("SELECT doc_id, source FROM documents").fetchall())
    taken, target, largest = {}, {}, {}
    for r in rows:
        s = sources[r.doc_id]
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
        largest[s] = max(largest.get(s, 0), r.size)
        assert r.taken <= 3 * r.size
    assert abs(sum(target.values()) - sum(r.size for r in rows)) < 1e-3
    assert all(abs(taken[s] - target[s]) <= max(0.05 * target[s], largest[s]) for s in taken)
    again = q.op10_mixing(spark, "/root/testdata/sf0.01").repartition(5).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_pipeline_stages(spark, con):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    items = [marked_words(t.encode()) for (t,) in con.sql("SELECT text FROM benchmark").fetchall()]
    windows = {tuple(w[i:i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, FOLDER)
        if name != "mixture":
            assert after.columns == columns
        old, new = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        assert new and set(new) <= set(old)
        if name == "near_copies":
            sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, t in old.items() if (w := (t or "").lower().split())}
            near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b])]
            root = {i: i for i in old}
            for _ in range(50):
                for a, b in near:
                    root[a] = root[b] = min(root[a], root[b])
            assert set(new) == {i for i in old if root[i] == i}
        if name == "line_dedup":
            seen = set()
            for i in sorted(new):
                keys = {k for line in (new[i].text or "").split("\n") if len(k := line.strip(" \t\n\x0b\f\r").lower()) >= 10}
                assert not keys & seen
                seen |= keys
        if name == "decontamination":
            for r in new.values():
                words = marked_words((r.text or "").encode())
                assert not windows & {tuple(words[i:i + 10]) for i in range(len(words) - 9)}
        before = spark.createDataFrame(after.toPandas(), after.schema)
