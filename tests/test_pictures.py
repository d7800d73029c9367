"""Kernels against brute force, galleries there and back, lineage against a plain walk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactsheet.functions import composition as C
from contactsheet.functions import kernels as K
from contactsheet.operators import lineage as L
from contactsheet.sources import gallery as G


@pytest.fixture(scope="module")
def grey():
    return np.random.default_rng(3).integers(0, 256, (24, 37)).astype(np.uint8)


@pytest.mark.parametrize(("h", "w"), [(8, 8), (24, 37), (5, 36), (1, 1), (30, 50)])
def test_area_resize(grey, h, w):
    want = np.zeros((h, w))
    sy, sx = grey.shape[0] / h, grey.shape[1] / w
    for y in range(h):
        for x in range(w):
            for i in range(grey.shape[0]):
                for j in range(grey.shape[1]):
                    inside = max(0, min((y + 1) * sy, i + 1) - max(y * sy, i)) * max(0, min((x + 1) * sx, j + 1) - max(x * sx, j))
                    want[y, x] += inside * grey[i, j] / (sy * sx)
    assert np.allclose(K.area_resize(grey, h, w), want)


def test_hashes_of_shifted_pictures_are_near():
    y, x = np.mgrid[:96, :128]
    picture = (128 + 60 * np.sin(x / 11) + 50 * np.cos(y / 7 + x / 23) + 15 * np.random.default_rng(1).normal(size=(96, 128))).clip(0, 255).astype(np.uint8)
    far = lambda a, b: bin((K.perceptual_hash(a) ^ K.perceptual_hash(b)) & (1 << 64) - 1).count("1")
    assert far(picture[:, 1:], picture[:, :-1]) <= 6 and far(picture, picture[::-1, ::-1].T.copy()) > 12
    assert K.fitted(picture, 32).shape == (24, 32) and K.fitted(picture, 500) is picture


def mirrored(a, y, x):
    h, w = a.shape
    at = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    return a[at(y, h), at(x, w)]


def test_means_and_blur(grey):
    a = grey.astype(float)
    box, soft = C.box_mean(a, 3), C.blurred(a)
    k = np.exp(-(np.arange(-4, 5) ** 2) / 12.5)
    k /= k.sum()
    for y, x in ((0, 0), (5, 9), (23, 36), (12, 0)):
        assert np.isclose(box[y, x], np.mean([mirrored(a, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        assert np.isclose(soft[y, x], sum(k[i + 4] * k[j + 4] * mirrored(a, y + i, x + j) for i in range(-4, 5) for j in range(-4, 5)))


def test_saliency_by_a_plain_transform():
    g = np.random.default_rng(5).integers(0, 256, (12, 10)).astype(np.uint8)
    n = lambda k: np.exp(-2j * np.pi * np.outer(np.arange(k), np.arange(k)) / k)
    f = n(12) @ g.astype(float) @ n(10)
    log = np.log(abs(f) + 1e-10)
    smooth = np.array([[np.mean([mirrored(log, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]) for x in range(10)] for y in range(12)])
    back = np.conj(n(12)) @ (np.exp(log - smooth) * f / abs(f)) @ np.conj(n(10)) / 120
    want = C.blurred(abs(back))
    assert np.allclose(C.saliency(g), (want - want.min()) / (want.max() - want.min()))
    assert C.subject(np.full((20, 30), 7, np.uint8))[0] >= 0  # nothing stands out


def test_subject_is_where_something_is():
    g = np.full((64, 64), 90, np.uint8)
    g[40:46, 10:16] = np.random.default_rng(2).integers(0, 256, (6, 6))
    y, x = np.unravel_index(C.saliency(g).argmax(), g.shape)
    assert abs(x - 12.5) < 7 and abs(y - 42.5) < 7
    (a, b), (c, d) = C.subject(g), C.subject(g[::-1, ::-1])
    assert abs(a + c - 63) < 1 and abs(b + d - 63) < 1  # a turned picture's subject is turned


def test_similarity_by_windows(grey):
    a, b = grey[:, :18], grey[:, 19:][:, ::-1]
    want = []
    for y in range(24 - 6):
        for x in range(18 - 6):
            p, q = a[y : y + 7, x : x + 7].astype(float).ravel(), b[y : y + 7, x : x + 7].astype(float).ravel()
            c = np.cov(p, q)
            want.append((2 * p.mean() * q.mean() + 6.5025) * (2 * c[0, 1] + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (c[0, 0] + c[1, 1] + 58.5225)))
    assert np.isclose(C.similarity(a, b), np.mean(want)) and np.isclose(C.similarity(a, a), 1)


def test_lines_lead_to_the_subject():
    edges = np.zeros((80, 80), bool)
    edges[30, 5:75] = True
    edges[np.arange(5, 75), np.arange(5, 75)] = True
    found = C.lines(edges)
    assert (30.0, np.radians(90)) in found and any(abs(r) <= 1 and abs(np.degrees(t) - 135) <= 1 for r, t in found)
    votes = {(r, t): sum(round(x * np.cos(t) + y * np.sin(t)) == r for y, x in zip(*np.nonzero(edges), strict=True)) for r, t in found}
    assert min(votes.values()) >= 50


def test_signals_of_known_pictures():
    flat = np.full((64, 64, 3), 120, np.uint8)
    got = C.composition(flat)
    assert got["balance"] == 10 and got["symmetry"] == 10 and got["harmony"] == 8.5 and got["profile"] == "no_faces" and got["dof"] == 5.0
    assert C.thirds(20, 20, 60, 60) == 10 and C.thirds(0, 0, 60, 60) == 0
    score, notes = C.golden(100 * 0.618 + 5, 38.2, 100, 100)
    assert 8 < score < 10 and notes == ["Crop 5% from right to align subject with phi line"]
    sharp = np.full((100, 100), 100, np.uint8)
    sharp[32:68, 32:68] = np.random.default_rng(1).integers(0, 256, (36, 36))
    assert C.depth_of_field(sharp) == 10 and C.depth_of_field(sharp, (34, 34, 20, 16)) > 3
    assert C.depth_of_field(255 - sharp[::-1]) == 10 and C.depth_of_field(np.full((100, 100), 9, np.uint8)) == 3.0
    red, green = np.zeros((10, 10, 3), np.uint8), np.zeros((10, 10, 3), np.uint8)
    red[..., 0], green[..., 1] = 200, 200
    hue, chroma = C.hues(np.stack([red, green]))
    assert abs(hue[0] - 40) < 1 and abs(hue[-1] - 136) < 1 and chroma.min() > 50
    assert C.harmony(red) == 8.5 and C.harmony(np.concatenate([red, green])) not in (8.5,)
    faces = C.composition(np.dstack([sharp] * 3), 9.0, (34, 34, 20, 16))
    assert faces["profile"] == "faces" and np.isclose(faces["composition"], sum(faces[k] * v for k, v in C.WEIGHTS["faces"].items()), atol=1e-4)


def test_scores_and_errors(spark):
    rng = np.random.default_rng(4)
    rows = [(1, 64, 64, bytearray(rng.integers(0, 256, 64 * 64 * 3, np.uint8)), None, None), (2, 64, 64, bytearray(5), None, None), (3, 8, 8, None, None, None), (4, 40, 30, bytearray(40 * 30 * 3), 7.0, [1, 2, 8, 8])]
    df = spark.createDataFrame(rows, "id long, width int, height int, pixels binary, face_placement double, face array<int>")
    got = {r.id: r for r in C.scores(df, "id").collect()}
    assert got[1].error is None and 0 <= got[1].composition <= 10 and got[2].error and got[3].error and got[4].profile == "faces" and got[4].face_placement == 7


def test_galleries_there_and_back(spark):
    assets = [("a", 0, "x", "x.jpg", "wide", 'alt "q" & <b>', "it's > that", "9", 3, 4), ("a", 1, "y.z", "y.z.png", "standard", "", "", "2", None, None), ("b", 0, "k", "k.jpg", "reveal-x", "&amp;", "&lt;", "ab12", 10, 20)]
    df = spark.createDataFrame(assets, "section string, sort_index int, slug string, file_name string, layout string, alt string, caption string, version string, width int, height int").repartition(3)
    got = G.parse_galleries(G.render_galleries(df, True)).orderBy("section", "sort_index").collect()
    assert [tuple(r)[:10] for r in got] == [(s, i, g, f, la, a, c, v, w, h) for s, i, g, f, la, a, c, v, w, h in assets] and all(r.error is None for r in got)


def test_galleries_that_are_wrong(spark):
    ok = '<figure><img src="media/a/f.jpg" alt=""><figcaption>c</figcaption></figure>'
    wrap = lambda x: f'<div class="gallery">\n{x}\n  </div>'
    pages = [("a", wrap(ok)), ("b", wrap(ok)), ("c", "<p>none</p>"), ("d", wrap("")), ("e", None), ("a2", wrap(ok.replace("media/a/", "media/a2/").replace("<figure>", '<figure class="odd">')))]
    got = {r.section: (r.error, r.version, r.layout) for r in G.parse_galleries(spark.createDataFrame(pages, "section string, html string")).collect()}
    assert got == {"a": (None, "2", "standard"), "b": ("another section's file", "2", "standard"), "c": ("no gallery", None, None), "d": ("no figures", None, None), "e": ("no gallery", None, None), "a2": ("unknown class", "2", "odd")}


def test_large_galleries_there_and_back(spark):
    """Indexes that are below 0, null, equal and far apart; sections of many pieces beside one of a single figure."""
    index = lambda i: None if i % 500 == 7 else 5000 if i % 100 == 3 else i * 40 - 9000
    rows = [("b" if i == 77 else "a", index(i), f"s{i}", f"s{i}.jpg", "tall", f"alt & {i}", "&lt;") for i in range(2000)]
    df = spark.createDataFrame(rows, "section string, sort_index int, slug string, file_name string, layout string, alt string, caption string").withColumns({"version": F.lit("2"), "width": F.lit(3), "height": F.lit(4)})
    got = G.parse_galleries(G.render_galleries(df.repartition(5))).orderBy("section", "sort_index").collect()
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    assert [(r.section, r.slug, r.alt, r.caption) for r in got] == [(r[0], r[2], r[5], r[6]) for r in want] and [r.sort_index for r in got] == [*range(1999), 0]
    assert all(r.error is None for r in got)


def test_pieces_without_lines_leave_none(spark):
    rows = [("a", 0, "x", "x.jpg"), ("a", 9000, "gone", None), ("a", 99_000, "y", "y.jpg"), ("b", 1, "gone", None)]
    df = spark.createDataFrame(rows, "section string, sort_index long, slug string, file_name string").selectExpr("*", "'standard' AS layout", "'' AS alt", "'' AS caption", "'2' AS version", "1 AS width", "1 AS height")
    got = {r.section: r.html for r in G.render_galleries(df).collect()}
    line = lambda x: f'      <figure><img src="media/a/{x}.jpg?v=2" alt="" loading="lazy"><figcaption></figcaption></figure>'
    assert got == {"a": f'<div class="gallery">\n{line("x")}\n{line("y")}\n    </div>', "b": '<div class="gallery">\n\n    </div>'}


def test_pages_are_searched_once_and_their_figures_in_many_tasks(spark):
    figures = "\n".join(f'<figure><img src="media/a/{i}.jpg" alt="{i}"><figcaption></figcaption></figure>' for i in range(400))
    pages = spark.createDataFrame([("a", f'<div class="gallery">\n{figures}\n</div>')], "section string, html string")
    got = G.parse_galleries(pages)
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[0]
    assert "html#" not in above and "figure#" in above
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_originals(spark):
    up = {i: i - 1 for i in range(1, 40)} | {0: None, 100: 999, 101: 100, 200: 201, 201: 200, 202: 200, 300: 300}
    got = {r.id: (r.original, r.steps) for r in L.originals(spark.createDataFrame(list(up.items()), "id long, up long"), "id", "up", rounds=8).collect()}
    assert got == {i: (0, i) for i in range(40)} | {100: (100, 0), 101: (100, 1)} | {i: (None, None) for i in (200, 201, 202, 300)}


def test_deltas_of_edits(spark):
    base = {f: None for f in L.FIELDS}
    rows = [(1, None, *(base | {"cull_score": 5.0, "print_score": 2.0}).values(), True, None), (2, 1, *(base | {"cull_score": 4.0}).values(), False, True), (3, 2, *(base | {"cull_score": 4.5}).values(), True, True), (4, 9, *base.values(), True, True)]
    df = spark.createDataFrame(rows, f"id long, edited_from_id long, {', '.join(f'{f} double' for f in L.FIELDS)}, {', '.join(f'{f} boolean' for f in L.FLAGS)}")
    got = sorted((r.id, r.field, r.delta, r.improved) for r in L.lineage_deltas(df).collect())
    assert got == [(2, "cull_score", -1.0, False), (2, "portfolio_worthy", -1.0, False), (3, "cull_score", 0.5, True), (3, "portfolio_worthy", 1.0, True), (3, "print_worthy", 0.0, False)]


def test_previews(spark):
    rows = [(1, 40, 20, bytearray(range(200)) * 4), (2, 4, 4, bytearray(3)), (3, 2, 2, bytearray(4))]
    got = {r.id: r for r in K.previews(spark.createDataFrame(rows, "id long, width int, height int, pixels binary"), "id", 10).collect()}
    assert (got[1].width, got[1].height, len(got[1].pixels)) == (10, 5, 50) and got[2].pixels is None and got[3].width == 2
