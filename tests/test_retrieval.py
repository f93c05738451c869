"""Best matches of damaged, cut and joined passages against a plain loop over the corpus."""

import math
import random

import pytest

from tessela.operators import retrieval


def lev(a, b, free=False):
    """Edit distance; with ``free``, of ``a`` from the nearest part of ``b``."""
    row = [0 if free else j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row) if free else row[-1]


def ratio(a, b):
    n = len(a) + len(b)
    return 1.0 if not n else (n - lev(a, b)) / n


def fit(q, t):
    return 1.0 if not q or q in t else max(0.0, 1 - lev(q, t, True) / len(q))


def r4(x):
    return math.floor(x * 1e4 + 0.5) / 1e4


def bare(s):
    return s.replace(" ", "")


def grams(s, n):
    return {s[i : i + n] for i in range(len(s) - n + 1)}


def boost(ns, passage):
    v, first = bare(passage), passage.split(" ")[0]
    return max(ratio(ns, v[: len(ns) + 6]), ratio(ns, first) if first else 0.0) if v else 0.0


def spans(corpus, longest):
    groups = {}
    for p in corpus:
        groups.setdefault(p["grp"], []).append(p)
    for g, ps in sorted(groups.items()):
        for i in range(len(ps)):
            for size in range(2, longest + 1):
                part = ps[i : i + size]
                if len(part) == size:
                    yield {"grp": g, "pos": part[0]["pos"], "pos_end": part[-1]["pos"], "size": size,
                           "joined": " ".join([part[0]["short"] or part[0]["joined"], *[p["joined"] for p in part[1:]]])}


def joint(text, corpus):
    ns = bare(text)
    overlap = {(p["grp"], p["pos"]): sum(w * len(grams(ns, n) & grams(bare(p["joined"]), n)) for n, w in ((2, 1.0), (3, 0.48))) for p in corpus}
    hit = sorted((k for k in overlap if overlap[k] > 0), key=lambda k: (-overlap[k], k)) if len(ns) >= 4 else []
    order = hit[:950] if len(hit) >= 80 else sorted(overlap)
    by_key = {(p["grp"], p["pos"]): p for p in corpus}
    scored = []
    for k in order:
        p = by_key[k]
        forms = [f for f in (p["joined"], p["short"]) if f]
        raw = max([0.0, *[ratio(text, f) for f in forms], *[boost(ns, f) for f in forms if len(ns) <= 10]])
        scored.append((p, raw))
    scored.sort(key=lambda x: -x[1])
    groups = list(dict.fromkeys(p["grp"] for p, _ in scored))[:32]
    singles = []
    for p, raw in scored:
        fits = [fit(ns, bare(f)) for f in (p["joined"], p["short"]) if f] if 8 <= len(ns) < 0.8 * len(bare(p["joined"])) else [0.0]
        better = max(fits)
        singles.append((raw + (better - raw) * 0.82 if better > raw else raw, raw, p))
    singles.sort(key=lambda x: -x[0])
    rows = [{**p, "pos_end": None, "score": r4(b), "raw": r4(raw), "o": (0, i, 0)} for i, (b, raw, p) in enumerate(singles[:32])]
    for s in spans(corpus, 6):
        if s["grp"] in groups:
            score = r4(ratio(text, s["joined"]))
            rows.append({**s, "score": score, "raw": score, "o": (groups.index(s["grp"]) + 1, s["pos"], s["size"])})
    return sorted(rows, key=lambda r: (-r["score"], r["o"]))[:18]


def rescored(text, s):
    raw = ratio(text, s["joined"])
    score = max(raw, raw + (fit(bare(text), bare(s["joined"])) - raw) * 0.82)
    return {**s, "score": r4(score), "raw": r4(raw), "whole": score}


def best(text, corpus):
    ns, found = bare(text), joint(text, corpus)
    top, late = found[0], found[0]["pos_end"] is not None and found[0]["pos"] > 1
    openers = {p["grp"] for p in corpus if p["pos"] == 1}
    heads = [s for s in spans(corpus, 7) if s["pos"] == 1 and s["grp"] in openers]
    pick = None
    texts = {(p["grp"], p["pos"]): p for p in corpus}
    for s in sorted(heads, key=lambda s: (s["grp"], s["size"])):
        one, two = texts[s["grp"], 1], texts.get((s["grp"], 2))
        f = bare(one["short"] or one["joined"])
        if len(ns) < 8 or not two or not f or len(f) > 10 or not ns.startswith(f):
            continue
        rest, follow = ns[len(f) :], bare(two["joined"])
        n = min(len(follow), len(rest), 12)
        got = rescored(text, s)
        if (n < 4 or ratio(rest[:n], follow[:n]) >= 0.72) and got["whole"] >= 0.48 and got["whole"] >= top["score"] - 0.18 and (pick is None or got["whole"] > pick["score"]):
            pick = got
    prefix = anywhere = []
    if late or top["score"] < 0.62:
        if len(ns) >= 34:
            ranked = [r for r in (rescored(text, s) for s in heads) if r["whole"] >= 0.5]
            prefix = sorted(ranked, key=lambda r: (-r["score"], r["grp"], r["size"]))[:12]
        if len(ns) >= 80:
            table = list(spans(corpus, 7))
            weight = [sum(w * len(grams(ns, n) & grams(bare(s["joined"]), n)) for n, w in ((2, 1.0), (3, 0.48))) for s in table]
            short = sorted((i for i in range(len(table)) if weight[i] > 0), key=lambda i: (-weight[i], table[i]["grp"], table[i]["pos"], table[i]["size"]))[:320]
            anywhere = sorted([r for r in (rescored(text, table[i]) for i in short) if r["whole"] >= 0.54], key=lambda r: -r["score"])[:12]
    collapse = [r for r in prefix if 34 <= len(ns) <= 115 and late and r["grp"] == top["grp"] and r["score"] >= 0.5 and r["pos_end"] >= top["pos_end"]]
    if pick is None and collapse:
        pick = max(collapse, key=lambda r: r["score"])
    if pick is None:
        options = [top, *[r for r in prefix if r["score"] >= top["score"] - 0.02], *[r for r in anywhere if r["score"] >= top["score"] - 0.015]]
        pick = max(options, key=lambda r: r["score"])
    end = pick["pos_end"] or pick["pos"]
    others = [r for r in found if not (r["grp"] == pick["grp"] and r["pos"] <= end and (r["pos_end"] or r["pos"]) >= pick["pos"])]
    frag = fit(ns, bare(pick["joined"]))
    margin = pick["score"] - max((r["score"] for r in others), default=0.0)
    return pick["grp"], pick["pos"], pick["pos_end"], pick["score"], r4(frag), r4(margin), r4(frag - max((fit(ns, bare(r["joined"])) for r in others), default=0.0))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(23)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(n))
    rows = []
    for g in range(1, 13):
        for p in range(1, 9):
            short = say(5) if p == 1 and g % 3 == 0 else None
            joined = say(1) if p == 1 and g in (4, 5) else f"zz yy {short}" if short else say(rng.randrange(3, 12))
            rows.append({"grp": g, "pos": p, "joined": joined, "short": short})
    return rows


def questions(corpus):
    rng = random.Random(29)
    texts = {(p["grp"], p["pos"]): p["joined"] for p in corpus}
    damaged = lambda t, k: "".join(rng.choice("abcxyz ") if rng.random() < k else c for c in t)
    out = [damaged(texts[rng.choice(sorted(texts))], 0.15) for _ in range(8)]
    out += [texts[g, p][len(texts[g, p]) // 3 :] for g, p in ((2, 3), (7, 8), (9, 5))]
    for g, p, n, k in ((1, 2, 2, 0.1), (3, 3, 4, 0.2), (6, 1, 3, 0.1), (8, 4, 5, 0.3), (10, 2, 4, 0.05), (4, 1, 3, 0.0), (5, 1, 4, 0.1), (11, 5, 3, 0.25)):
        out.append(damaged(" ".join(texts[g, q] for q in range(p, p + n)), k))
    return [" ".join(t.split()) for t in out] + ["ab", "abc de", "a", texts[1, 1][:7], "qqqq wwww"]


def test_best_match_equals_a_loop(spark, corpus):
    asked = list(enumerate(questions(corpus)))
    c = spark.createDataFrame([(p["grp"], p["pos"], p["joined"], p["joined"], p["short"]) for p in corpus], "grp long, pos long, display string, joined string, short string")
    got = {r.query_id: r for r in retrieval.best_match(spark.createDataFrame(asked, "query_id int, text string"), c).collect()}
    kinds = set()
    for i, text in asked:
        want, r = best(text, corpus), got[i]
        assert (r.grp, r.pos, r.pos_end) == want[:3], text
        assert [r.score, r.frag_fit, r.margin, r.fit_margin] == pytest.approx(list(want[3:]), abs=2e-4), text
        kinds.add((r.pos_end is None, r.score < 0.62))
    assert len(kinds) >= 3
