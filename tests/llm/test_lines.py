"""Fuzzy line dedup against exact Jaccard over all pairs of lines."""

import random

from tessela.llm import line_dedup


def normal(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line).strip(" ")


def shingles(line):
    k = line_dedup.SHINGLE
    return {line[i : i + k] for i in range(len(line) - k + 1)} or {line}


def test_lines(docs_of):
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    bases = [say(rng.choice([1, 6, 20, 60])) for _ in range(40)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(5)):
            line = rng.choice(bases) if rng.random() < 0.6 else say(8)
            if rng.random() < 0.4:
                at = rng.randrange(len(line))
                line = line[:at] + "Z" + line[at + 1 :]
            lines.append(rng.choice([line, line.upper(), f"  {line} "]))
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "\n \n"), (903, "ab\nAB\n ab"), (None, "ab"), (904, "q" * 100_000)]
    got = line_dedup.dedup_lines(docs_of(rows)).collect()
    lines = [(i, n, normal(x)) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    assert len(got) == len(lines)
    texts = sorted({x for _, _, x in lines if x})
    parent = {x: x for x in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {x: shingles(x) for x in texts}
    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = {}
    for i, n, x in lines:
        if x:
            groups.setdefault(find(x), []).append((i is None, i, n))
    want = {}
    for g in groups.values():
        stay = min(g)
        for place in g:
            want[place] = (stay[1], stay[2], len(g), place == stay)
    missed = sum((r.component_doc_id, r.component_line_no, r.component_size, r.kept) != want.get((r.doc_id is None, r.doc_id, r.line_no), (None, None, None, True)) for r in got)
    assert missed <= 0.02 * len(got)
    assert line_dedup.dedup_lines(docs_of([])).collect() == []


def test_rulers_of_any_length(docs_of):
    got = line_dedup.dedup_lines(docs_of([(0, "-" * 30), (1, "-" * 100)])).collect()
    assert {(r.doc_id, r.component_doc_id, r.component_size, r.kept) for r in got} == {(0, 0, 2, True), (1, 0, 2, False)}


def test_repeats_and_short_lines(docs_of):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(["-" * 11, "-" * 12, "-" * 30, "-" * 100, "word " * 50 + "w", "word " * 500 + "w"])]
    pairs = []
    for n in range(12, 19):
        for _ in range(30):
            line = "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
            pairs.append((line, line + "q"))
    rows += [(100 + i, "\n".join(p)) for i, p in enumerate(pairs)]
    got = line_dedup.dedup_lines(docs_of(rows)).collect()
    first = {(r.doc_id, r.line_no): (r.component_doc_id, r.component_size, r.kept) for r in got}
    assert all(first[i, 0] == (0, 4, i == 0) for i in range(4))
    assert all(first[i, 0] == (4, 2, i == 4) for i in (4, 5))
    for i, (a, b) in enumerate(pairs):
        assert len(shingles(a) & shingles(b)) >= 0.75 * len(shingles(a) | shingles(b))
        assert first[100 + i, 0] == (100 + i, 2, True) and first[100 + i, 1] == (100 + i, 2, False)


def test_similarity_of_pairs_is_exact(docs_of, monkeypatch):
    """Pairs are decided without sketches, short lines by the shingles themselves; characters
    beyond the basic plane count as one, also where lines are long."""
    rng = random.Random(2)
    base = "".join(rng.choice("abc é漢🙂🙃") for _ in range(300))
    lines = [base, "ab", "🙂" * 9, "🙂" * 12, "a" * 40]
    for edits in (1, 3, 5, 8):
        chars = list(base)
        for _ in range(edits):
            chars[rng.randrange(300)] = "🙃x"
        lines.append("".join(chars))
    sets = [shingles(x) for x in lines]
    frame = docs_of(list(enumerate(lines))).selectExpr("doc_id AS lid", "text AS line")
    pairs = frame.selectExpr("lid AS a").crossJoin(frame.selectExpr("lid AS b")).filter("a < b")
    for long in (line_dedup.LONG, 50):
        monkeypatch.setattr(line_dedup, "LONG", long)
        for least in (0.3, 0.6, 0.75, 0.9):
            got = {(r.a, r.b) for r in line_dedup.similar(frame, pairs, least).collect()}
            assert got == {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and len(x & y) >= least * len(x | y)}


def test_only_agreeing_lines_are_sketched(docs_of, monkeypatch):
    """Before, all lines of a bucket that star pairs or open pairs could come from were."""
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    base = say(30)
    rows = [(i, base[:at] + "Q" + base[at + 1 :]) for i, at in enumerate(rng.sample(range(200), 20))]
    sketched = []
    make = line_dedup.sketches
    monkeypatch.setattr(line_dedup, "sketches", lambda lines: sketched.append(lines.count()) or make(lines))
    got = line_dedup.dedup_lines(docs_of(rows)).collect()
    assert {r.component_size for r in got} == {20} and sum(sketched) == 0


def test_centre_is_the_line_with_least_of_its_own(docs_of):
    """Before, a bucket's centre was any of its lines, and those with a passage in common met
    each other by pairs."""
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    base = say(60)
    frame = docs_of([(99, base)] + [(i, base + " " + say(25)) for i in range(1, 40)]).selectExpr("doc_id AS lid", "text AS line")
    members = line_dedup.bucket_members(line_dedup.written(line_dedup.signatures(frame), "signatures")).collect()
    size = {}
    for m in members:
        size[m.key] = size.get(m.key, 0) + 1
    hubs = [m.hub for m in members if size[m.key] >= 12]
    assert hubs and set(hubs) == {99}


def test_open_pairs_come_out_once_and_none_is_lost(docs_of):
    """Lines of a bucket in different components meet; each pair comes out by the first key
    that it shares, and sketches give up no pair that is similar."""
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    lines = []
    for _ in range(6):
        base = say(rng.choice([2, 8, 40])).split()
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 12)):
                words[rng.randrange(len(words))] = say(1)
            lines.append(" ".join(words) + rng.choice(["", " é", " ab"]))
    lines = sorted(set(lines)) + ["-" * 12, "-" * 30, "-" * 50]
    frame = line_dedup.written(docs_of(list(enumerate(lines))).selectExpr("doc_id AS lid", "text AS line"), "lines")
    signed = line_dedup.written(line_dedup.signatures(frame), "signatures")
    members = line_dedup.bucket_members(signed)
    still = line_dedup.open_members(members, docs_of([]).selectExpr("doc_id AS node", "doc_id AS root"))
    known = line_dedup.open_lines(still, signed, frame)
    out = [(r.a, r.b) for r in line_dedup.open_pairs(still, known, 0.75).collect()]
    assert len(out) == len(set(out))
    sets = [shingles(x) for x in lines]
    assert {r.lid: r.n for r in known.collect()} == {r.lid: len(sets[r.lid]) for r in known.collect()}
    buckets, hub = {}, {}
    for m in members.collect():
        buckets.setdefault(m.key, set()).add(m.lid)
        hub[m.key] = m.hub
    minima = {r.lid: r for r in signed.collect()}
    agreed = lambda a, b: minima[a].few or minima[b].few or sum(minima[a][m] == minima[b][m] for m in line_dedup.MINIMA) >= line_dedup.AGREE
    want = set()
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            if a < b and len(x & y) >= 0.75 * len(x | y) and agreed(a, b):
                shared = [k for k, v in buckets.items() if {a, b} <= v]
                if shared and not any(hub[k] in (a, b) for k in shared):
                    want.add((a, b))
    assert want and want <= set(out)
