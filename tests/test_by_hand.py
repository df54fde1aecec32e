"""Turn cues and tours against plain versions of their rules."""

from __future__ import annotations

import itertools
import math
import random

from pathloom.operators import cues, routing

MILES = 111_194.92664455873  # metres of a degree on the sphere of cues.EARTH_M


def bearing(p, q):
    a1, a2, d = math.radians(p[0]), math.radians(q[0]), math.radians(q[1] - p[1])
    return math.degrees(math.atan2(math.sin(d) * math.cos(a2), math.cos(a1) * math.sin(a2) - math.sin(a1) * math.cos(a2) * math.cos(d))) % 360


def metres(p, q):
    a1, a2 = math.radians(p[0]), math.radians(q[0])
    s, t = math.sin((a2 - a1) / 2), math.sin(math.radians(q[1] - p[1]) / 2)
    return 2 * cues.EARTH_M * math.asin(math.sqrt(s * s + math.cos(a1) * math.cos(a2) * t * t))


def turned(a, b):
    return (a - b + 180) % 360 - 180


def named(angle):
    a, side = abs(angle), "left" if angle < 0 else "right"
    return "u_turn" if a > 170 else f"sharp_{side}" if a > 135 else side if a > 45 else f"slight_{side}" if a > 20 else "straight"


def cues_by_hand(points, passed, edges, places):
    """Decision by decision: group, turn, mute, refine."""
    near = {}
    for s, t, layer, _ in edges:
        near.setdefault(s, set()).add((t, layer))
        near.setdefault(t, set()).add((s, layer))
    deciding = {v for v, n in near.items() if len({x for x, _ in n}) >= 3}
    group = {v: v for v in deciding}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    for s, t, _, length in edges:
        if length <= 20 and s in deciding and t in deciding:
            group[root(s)] = root(t)
    out = set()
    for route in {p[0] for p in points}:
        line = sorted((p[1], (p[2], p[3])) for p in points if p[0] == route)
        cum, at = [0.0], {}
        for (_, p), (_, q) in zip(line, line[1:]):
            cum.append(cum[-1] + metres(p, q))
        for k, (seq, p) in enumerate(line):
            back = next((line[i][1] for i in range(k, -1, -1) if cum[i] <= cum[k] - 15), line[0][1])
            ahead = next((line[i][1] for i in range(k, len(line)) if cum[i] >= cum[k] + 15), line[-1][1])
            at[seq] = (cum[k], bearing(back, p), bearing(p, ahead))
        met = [x for x in sorted((x for x in passed if x[0] == route), key=lambda x: x[2]) if x[1] in deciding]
        clusters = []
        for x in met:
            last = clusters[-1][-1] if clusters else None
            same = last and (last[1] == x[1] and at[x[2]][0] - at[last[2]][0] <= 20 or last[1] != x[1] and root(last[1]) == root(x[1]))
            if same:
                clusters[-1].append(x)
            else:
                clusters.append([x])
        for own in clusters:
            first, last, inside = own[0], own[-1], {x[1] for x in own}
            branches = sorted((v, n, layer) for v in inside for n, layer in near[v] if n not in inside | {first[5], last[6]})
            road = any(b[2] == "road" for b in branches)
            outward = at[last[2]][2]
            cue = named(turned(outward, at[first[2]][1]))
            if first[3] == last[4] == "cartpath" and road and cue in ("straight", "slight_left", "slight_right"):
                continue
            off = [turned(bearing(places[v], places[n]), outward) for v, n, layer in branches if layer != "road"]
            if cue == "straight" and not any(abs(d) <= 45 for d in off):
                continue
            close = next((d for d in off if abs(d) <= 30), None)
            if cue.startswith("slight") and close is not None:
                cue = "right_fork" if close > 0 else "left_fork"
            out.add((route, first[2], cue))
    return out


def test_course_points_by_hand(spark):
    rnd, side = random.Random(12), 7
    spots = [0.0, 14.0, 70.0, 83.0, 150.0, 220.0, 235.0]
    places = {i * side + j: (40 + (spots[i] + rnd.uniform(-4, 4)) / MILES, -84 + (spots[j] + rnd.uniform(-4, 4)) / MILES) for i in range(side) for j in range(side)}
    edges = []
    for i, j in itertools.product(range(side), repeat=2):
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < side and b < side and rnd.random() < 0.8:
                u, v = i * side + j, a * side + b
                edges.append((u, v, rnd.choice(["cartpath", "cartpath", "road"]), metres(places[u], places[v])))
    layer_of = {frozenset(e[:2]): e[2] for e in edges}
    near = {}
    for u, v, _, _ in edges:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    points, passed = [], []
    for route in range(25):
        walk = [rnd.choice(sorted(near))]
        for _ in range(14):
            walk.append(rnd.choice(sorted(near[walk[-1]])))
        seq = 0
        for k, v in enumerate(walk):
            if k:
                u = walk[k - 1]
                for f in (0.3, 0.6):
                    points.append((route, seq, *(places[u][i] + (places[v][i] - places[u][i]) * f for i in (0, 1))))
                    seq += 1
            points.append((route, seq, *places[v]))
            if 0 < k < len(walk) - 1:
                passed.append((route, v, seq, layer_of[frozenset((walk[k - 1], v))], layer_of[frozenset((v, walk[k + 1]))], walk[k - 1], walk[k + 1]))
            seq += 1
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = cues.course_points(
        df(points, "route long, seq long, lat double, lon double"), df([(r, v, s, a, b, f, t) for r, v, s, a, b, f, t in passed], "route long, vertex long, seq long, layer_in string, layer_out string, from_vertex long, to_vertex long"),
        df(edges, "source long, target long, layer string, length_m double"), df([(v, *p) for v, p in places.items()], "vertex long, lat double, lon double"),
    )
    want = cues_by_hand(points, [(r, v, s, a, b, f, t) for r, v, s, a, b, f, t in passed], edges, places)
    assert {(r["route"], r["seq"], r["cue"]) for r in got.collect()} == want and len(want) > 60


def best_tour(ends, home, dist):
    """The least deadhead over all orders and directions, by subsets."""
    n = len(ends)
    best = {(1 << k, k, w): dist(home, ends[k][w]) for k in range(n) for w in (0, 1)}
    for mask in range(1, 1 << n):
        for k in range(n):
            for w in (0, 1):
                if (mask, k, w) in best:
                    at = ends[k][1 - w]
                    for m in range(n):
                        if not mask >> m & 1:
                            for x in (0, 1):
                                key, d = (mask | 1 << m, m, x), best[mask, k, w] + dist(at, ends[m][x])
                                if d < best.get(key, math.inf):
                                    best[key] = d
    full = (1 << n) - 1
    return min(best[full, k, w] + dist(ends[k][1 - w], home) for k in range(n) for w in (0, 1))


def test_tours_are_near_the_best():
    rnd, ratios = random.Random(3), []
    for _ in range(30):
        spot = {v: (rnd.random(), rnd.random()) for v in range(17)}
        dist = lambda a, b, s=spot: math.dist(s[a], s[b])
        ends = [(2 * k + 1, 2 * k + 2) for k in range(8)]
        cost = {(a, b): dist(a, b) for a in spot for b in spot if a != b}
        at, total = 0, 0.0
        for k, forwards in routing._tour(ends, 0, cost):
            a, b = ends[k] if forwards else ends[k][::-1]
            total, at = total + dist(at, a), b
        ratios.append((total + dist(at, 0)) / best_tour(ends, 0, dist))
    assert min(ratios) > 1 - 1e-9 and max(ratios) < 1.05 and sum(r < 1 + 1e-9 for r in ratios) >= 20, sorted(ratios)
