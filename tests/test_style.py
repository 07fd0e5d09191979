"""Style rounds and the character check against plain NumPy over planted scopes."""

import numpy as np
import pytest

from quarrykit.operators import style
from quarrykit.operators.style import TEXTURED, Weights, assess, character_check, unit


def planted():
    rng = np.random.default_rng(11)
    rows, i = [], 0
    for label, n, strays in ((1, 40, 5), (2, 6, 2), (3, 9, 4), (4, 1, 0), (5, 12, 0)):
        base = rng.normal(size=(3, 8))
        for k in range(n):
            v = base + rng.normal(0, 0.15, (3, 8))
            if k < strays:
                v[rng.integers(0, 2) : 2] = rng.normal(size=(8,))
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            rows.append((i, label, *[[float(x) for x in f] for f in v]))
            i += 1
    return rows


def plain_scope(fams, w):
    """Outcome of one scope: (combined, active, removed, low flags)."""
    n = len(fams[0])
    on, removed = np.ones(n, bool), [None] * n

    def look():
        sims, cuts, score, near, sds = [], [], [], [], []
        for f in fams:
            gram, k = f @ f[on].T, int(on.sum())
            total = gram.sum(1)
            sim = np.where(on & (k > 1), (total - (f * f).sum(1)) / max(k - 1, 1), total / k)
            mean, sd = sim[on].mean(), sim[on].std()
            cut, floor = max(0, mean - style.SIGMA * sd), max(0, mean - max(0.18, 2 * sd))
            top = max(mean, floor + 1e-6)
            far = ((f - f[on].mean(0)) ** 2).sum(1)
            sims.append(sim)
            cuts.append(cut)
            sds.append(sd)
            score.append(np.clip((sim - floor) / (top - floor) * 100, 0, 100))
            near.append(100 - np.clip(far / max(2 * far[on].mean(), 1e-6) * 100, 0, 100))
        floor = max(0, cuts[2] - max(0.1, 1.5 * sds[2]))
        rail = np.where(sims[2] >= cuts[2], 100, np.clip((sims[2] - floor) / (max(cuts[2], floor + 1e-6) - floor) * 100, 0, 100))
        total = w.main * score[0] + w.texture * (w.average * score[1] + w.centroid * near[1]) + w.guard * rail
        return total, sims[0] < cuts[0], (sims[1] < cuts[1]) & (w.texture > 0)

    for nth in range(1, 4):
        total, a, b = look()
        bad = [j for j in range(n) if on[j] and (a[j] or b[j]) and total[j] < style.MIN_SCORE] if n >= style.LEAST else []
        bad = sorted(bad, key=lambda j: (total[j], j))[: max(0, int(on.sum()) - 2)]
        for j in bad:
            on[j], removed[j] = False, nth
    return (*look(), on, removed)


@pytest.mark.parametrize("w", [Weights(), TEXTURED])
def test_rounds(spark, w):
    rows = planted()
    got = {r["vec_id"]: r for r in assess(spark.createDataFrame(rows, "vec_id long, label int, main array<double>, texture array<double>, guard array<double>"), w).collect()}
    reasons = set()
    for label in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == label]
        total, a, b, on, removed = plain_scope([np.array([r[k] for r in mine]) for k in (2, 3, 4)], w)
        for j, r in enumerate(mine):
            out = got[r[0]]
            assert out["combined"] == pytest.approx(total[j], abs=1e-6) and (out["core"], out["removed"]) == (on[j], removed[j])
            want = ("main_and_texture" if a[j] and b[j] else "main" if a[j] else "texture") + "_below_threshold" if not on[j] else "small_scope_review" if len(mine) < 8 and (a[j] or b[j]) and total[j] < style.MIN_SCORE else None
            assert out["reason"] == want
            reasons.add(want)
    assert "small_scope_review" in reasons and len(reasons) >= 3 and len(got) == len(rows)


def test_two_rows_stay_however_alike_none_are(spark, monkeypatch):
    monkeypatch.setattr(style, "SIGMA", -50.0)  # every row is under its scope's threshold
    rng = np.random.default_rng(4)
    turn = [[float(np.cos(x)), float(np.sin(x))] for x in rng.uniform(0, 1, 9)]
    rows = [(i, 1, t, t, t) for i, t in enumerate(turn)]
    got = assess(spark.createDataFrame(rows, "vec_id long, label int, main array<double>, texture array<double>, guard array<double>")).collect()
    assert sum(r["core"] for r in got) == 2 and {r["removed"] for r in got} == {1, None}


def test_character_check(spark):
    rows = [(r[0], r[1], r[2]) for r in planted()] + [(900 + k, 9, [float(k == d) for d in range(8)]) for k in range(2)]
    got = {r["vec_id"]: r for r in character_check(spark.createDataFrame(rows, "vec_id long, label int, main array<double>")).collect()}
    for label in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == label]
        f, on = np.array([r[2] for r in mine], float), np.ones(len(mine), bool)
        for _ in range(2 if len(mine) >= 4 else 0):
            k = int(on.sum())
            total = (f @ f[on].T).sum(1)
            sim = np.where(on & (k > 1), (total - 1) / max(k - 1, 1), total / k)
            bad = on & (sim < sim[on].mean() - 2.04 * sim[on].std())
            if k - bad.sum() >= 2:
                on &= ~bad
        c = f[on].mean(0)
        near = f @ c / np.linalg.norm(c)
        cut = near[on].mean() - 2.04 * near[on].std()
        for j, r in enumerate(mine):
            assert got[r[0]]["near"] == pytest.approx(near[j]) and got[r[0]]["review"] == (len(mine) >= 4 and (not on[j] or near[j] < cut - 1e-6))
    assert got[900]["reason"] == "insufficient_scope_size" and any(r["review"] for r in got.values())


def test_empty(spark):
    t = spark.createDataFrame([], "vec_id long, label int, main array<double>, texture array<double>, guard array<double>")
    assert assess(t).count() == 0 and character_check(t.select("vec_id", "label", "main")).count() == 0


@pytest.mark.parametrize("v", [[0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], None])
def test_rows_without_length_are_errors(spark, v):
    t = spark.createDataFrame([(v,)], "v array<double>")
    with pytest.raises(Exception, match="no finite, positive length"):
        t.select(unit(t["v"])).collect()


def test_weights_sum_to_one():
    with pytest.raises(ValueError, match="sum to 1"):
        Weights(0.5, 0.5, 0.5)
