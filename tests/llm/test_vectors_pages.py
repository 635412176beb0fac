"""Embedding near-dedup, HTML extraction, components and the pipeline."""

import collections
import math
import random
import re

import numpy as np
import pytest
import cases
from cases import frame

from signalloom.llm import components, html, packing, vectors
from signalloom.llm.shared import Scratch


def plain_links(rows, least):
    """Links and components of valid rows, by all cosines."""
    ok = [i for i, (d, v) in enumerate(rows) if d is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    links = dict.fromkeys(range(len(rows)), 0)
    label = {d: d for d, _ in rows}
    pairs = []
    for i in ok:
        for j in ok:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i < j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                pairs.append((rows[i][0], rows[j][0]))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return [(d, links[i], label[d], d is None or label[d] == d) for i, (d, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(11)
    rows = []
    for k in range(12):
        centre = rng.normal(size=16)
        rows += [(len(rows) + j, (centre + rng.normal(size=16) * 0.15 * (j % 4)).tolist()) for j in range(k + 1)]
    rows += [(200 + i, rng.normal(size=16).tolist()) for i in range(60)]
    rows += [(300 + i, rows[5][1]) for i in range(7)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [1.0, float("inf")]), (405, [None, 1.0]), (406, [1.0, 2.0]), (407, [2.0, 4.0])]
    rows += [(None, rows[3][1]), (408, rows[5][1]), (408, rows[5][1])]
    return rows


@pytest.mark.parametrize("block", [1_024, 8])
def test_near_vectors(spark, vector_rows, block):
    df = spark.createDataFrame([(d, v, 1, 2) for d, v in vector_rows], "vec_id long, embedding array<double>, label int, cell int").repartition(4)
    got = collections.Counter(tuple(r) for r in vectors.near_vectors(df, block=block).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == collections.Counter(plain_links(vector_rows, 0.9))


def test_recall_of_border_pairs(spark):
    """Pairs just above the limit, the hardest to find, among unrelated vectors."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1_500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(axis=1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    cosine = rng.uniform(0.901, 0.95, size=(1_500, 1))
    near = cosine * base + np.sqrt(1 - cosine**2) * other
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = got.where("n_links > 0").count()
    assert found >= 0.9 * 3_000
    assert got.where("n_links > 1").count() == 0


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_long_chains_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(1_000, 1_000 + i) for i in range(200)] + [(5, 5), (7, None), (3_000, 2_999), (2_999, 3_000)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()}
    want = dict.fromkeys(range(301), 0) | dict.fromkeys(range(1_000, 1_200), 1_000) | {2_999: 2_999, 3_000: 2_999}
    assert got == want
    assert components.connected(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def page(k: int, article: str, tag: str = "article") -> str:
    return (
        f"<!DOCTYPE html><html><head><title>t {k}</title><style>p{{}}</style></head><body><nav><ul><li><a href='/x'>Home {k}</a></li><li><a>News</a></li></ul></nav>"
        f'<!-- ad --><div class="ad">Buy things now {k}</div><{tag}>{article}</{tag}><aside>See also other words here</aside>'
        f"<form><p>Your name</p><input></form><div class='comments'><p>I said so {k}</p></div><footer>&copy; 20{k:02d}</footer><script>var p='</p>';</script>"
    )


def test_best_region_is_the_greatest_of_all():
    rng = random.Random(8)
    for _ in range(400):
        scores = [rng.choice([-3.0, -1.0, -0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 25))]
        low, high = html.best_region(scores)
        every = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        assert sum(scores[low:high]) == max([0.0, *every.values()])
        assert (low < high) == any(v > 0 for v in every.values())


def plain_tags(text: str) -> list[str]:
    """Tags as they come, each start tried by itself to the end of the text."""
    found, at = [], 0
    while at < len(text):
        m = re.match(r"</?[a-zA-Z][^\s/>]*", text[at:])
        end, quote = at + m.end() if m else len(text), ""
        while end < len(text) and (quote or text[end] != ">"):
            quote = "" if text[end] == quote else quote or (text[end] if text[end] in "\"'" else "")
            end += 1
        if end < len(text):
            found.append(text[at : end + 1])
            at = end
        at += 1
    return found


def test_tags_without_an_end():
    rng = random.Random(3)
    bits = ["<a ", "<b>", "</b>", '<p class="x y">', '"', "'", ">", "<", "<div", "text ", "<x/>", " = ", "/", "</p>"]
    for _ in range(3_000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 16)))
        assert [m[0] for m in html._tags(text)] == plain_tags(text), text
    # Up to 5 MB of each; read again from every start, one would take hours. A tag without an end is text.
    for text in ('<a "' * 1_300_000, "<a " * 500_000, "<!" * 500_000, "<script " * 200_000, "<aaaa" * 300_000):
        assert html.main_text(text, {}) == text.strip()
    assert html.main_text("<b>x" * 200_000, {}) == "x" * 200_000
    assert html.main_text("<b>" * 150_000 + "</i>" * 150_000, {}) == ""


def test_places_above_the_usual_capacity():
    counts = np.zeros(9_001, dtype=np.int64)
    counts[[9_000, 6_500, 2_500, 100]] = [2, 3, 3, 1]
    plan = packing.plan(counts, 9_000)
    slots = packing.Slots(plan)
    length = np.repeat([9_000, 6_500, 2_500, 100], [2, 3, 3, 1])
    rank = np.array([0, 1, 0, 1, 2, 0, 1, 2, 0])
    sequence, offset = slots.place(length, rank)
    own = collections.defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True):
        own[s].append((o, n))
    assert len(own) == 6
    for parts in own.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 9_000


def test_html(spark):
    body = "<h1>Title &amp; {k}</h1><p>First  <b>bold</b>\n words<br>after</p><p>Left open &#233;&nbsp;x<ul><li>item one</li><li>two</ul><p>" + "last words " * 30 + "</p>"
    rows = [(k, f"u{k}", page(k, body.replace("{k}", str(k))), "x") for k in range(60)]
    rows += [(100, None, None, "x"), (101, "u", "", "x"), (None, "u", page(5, "<p>some text of an article</p>"), "x"), (102, "u", "no tags at all & more", "x"), (103, "u", "<nav><a>only</a></nav>", "x"), (104, "u", "<" * 1_000, "x")]
    rows += [(105, "u", page(7, "<p>" + "a long text " * 40 + "</p><p>of two blocks</p>", "div"), "x"), rows[3]]
    got = collections.defaultdict(list)
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)).collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]].append(r["text"])
    for k in range(60):
        assert got[k][0] == f"Title & {k}\nFirst bold words\nafter\nLeft open é x\nitem one\ntwo\n" + ("last words " * 30).strip()
    assert len(got[3]) == 2 and got[3][0] == got[3][1]
    assert got[100] == got[101] == [""]
    assert got[None] == ["some text of an article"]
    assert got[102] == ["no tags at all & more"] and got[103] == [""]
    assert got[105] == [("a long text " * 40).strip() + "\nof two blocks"]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    # Besides the passages on lines of their own, which go with the lines, one inside other lines.
    rng = random.Random(11)
    shared = cases.sentence(rng, 40)
    inside = [(500 + i, f"{cases.sentence(rng, 60)} {shared} {cases.sentence(rng, 60)}", "en", "s", 0, "x", 1, 2, 3, "y", None) for i in range(3)]
    docs = frame(spark, cases.rows() + inside)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100, 140)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, left, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            left = spark.read.parquet(f"{tmp_path}/{name}")
            seen[name] = left.collect()
        else:
            packed = out.collect()
    assert all(len((r["text"] or "").split()) >= 50 for r in seen["quality_rules"])
    assert {r["doc_id"] for r in seen["line_dedup"]} == {r["doc_id"] for r in seen["quality_rules"]}
    near = {r["doc_id"] for r in seen["near_duplicates"]}
    assert 200 in near and not near & set(range(201, 212))  # near copies of one text
    assert sum(len(r["text"].split()) for r in seen["substring_dedup"]) < sum(len(r["text"].split()) for r in seen["near_duplicates"])
    words = {r["doc_id"]: r["text"].split() for r in seen["substring_dedup"]}
    assert [len(words[500 + i]) for i in range(3)] == [160, 120, 120]
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in seen["substring_dedup"]}
    for name in ("line_dedup", "substring_dedup"):
        assert all(r["n_chars"] == len(r["text"]) for r in seen[name] if r["text"] is not None)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["ids_crc32"])
    assert [key(r) for r in sorted(whole, key=key)] == [key(r) for r in sorted(packed, key=key)]
