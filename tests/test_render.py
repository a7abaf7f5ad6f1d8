"""Representations against texts that plain Python writes from the same scenes, all scenes at once.

The scenes are random: with and without floors, places, connections and relations; ids of
digits and of letters; ties in distances, degrees and counts; unknown objects in relations.
"""

import json
import math
import random
from collections import Counter

import pytest

from scenespark.operators import render as V
from scenespark.operators.relations import DIRECTIONAL, PROXIMITY, SUPPORT

SECTORS = ["east", "north-east", "north", "north-west", "west", "south-west", "south", "south-east"]
KINDS = ["standing on", "part of", "close by", "next to", "left", "above", "same color", "same type", "bigger than", "pointing at"]


def key(i):
    return (0, int(i), "") if i.isdigit() else (1, 0, i)


class Scene:
    def __init__(self, n, rng):
        self.id, self.name = f"scene{n}", f"House {n}"
        size = rng.choice([1, 2, 5, 9])
        ids = rng.sample([*map(str, range(1, 30)), "b", "a1"], size)
        floors = n % 3 == 0
        place = lambda: None if rng.random() < 0.15 else (rng.randint(0, 6) / 2, rng.randint(0, 1) / 4, rng.randint(0, 8) / 2)
        self.rooms = [{"id": i, "category": rng.choice(["kitchen", "hall", None]), "floor": rng.choice(["0", "1", None]) if floors else None, "at": place()} for i in ids]
        self.links = {i: [] for i in ids} if n % 4 else {}
        if self.links:
            for a in ids:
                for b in ids:
                    if a < b and rng.random() < 0.35:
                        self.links[a].append(b)
                        self.links[b].append(a)
            for near in self.links.values():
                rng.shuffle(near)
        names = rng.sample([*map(str, range(100, 140)), "x", "lamp"], rng.choice([0, 6, 12]))
        self.objects = [{"id": o, "room": rng.choice(ids), "category": rng.choice(["cup", "table", "chair", None]), "short": rng.choice([None, None, "9" + o])} for o in names]
        self.relations = [(rng.choice(names), rng.choice(KINDS), rng.choice([*names, "ghost"])) for _ in range(rng.choice([0, 25]))] if names and n % 5 else []

    # what several texts share
    def label(self, room):
        return f"{room['category'] or 'room'} [{room['id']}]"

    def thing(self, o):
        found = next((x for x in self.objects if x["id"] == o), None)
        return f"{found['category'] or 'object'} [{found['short'] or o}]" if found else f"object [{o}]"

    def held(self, room):
        return [o for o in self.objects if o["room"] == room["id"]]

    def counted(self, names):
        return ", ".join(f"{c} (×{n})" if n > 1 else c for c, n in Counter(names).most_common())

    def contents(self, room):
        return self.counted(o["category"] or "object" for o in self.held(room)) or "no objects"

    def types(self, rooms):
        return self.counted(r["category"] for r in rooms if r["category"])

    def degree(self, room):
        return len(set(self.links.get(room["id"], [])))

    def by_degree(self, rooms):
        return sorted(rooms, key=lambda r: (-self.degree(r), key(r["id"])))

    @property
    def connected(self):
        return any(self.links.values())

    @property
    def placed(self):
        return [r for r in self.rooms if r["at"]]

    def groups(self):
        """(floor, rooms, the two axes of the floor's plane)"""
        named = sorted({r["floor"] for r in self.rooms if r["floor"]})
        parts = [(f, [r for r in self.placed if r["floor"] == f]) for f in [*named, None]] if len(named) >= 2 else [(None, self.placed)]
        out = []
        for f, rooms in parts:
            if rooms:
                spread = []
                for k in range(3):
                    mean = sum(r["at"][k] for r in rooms) / len(rooms)
                    spread.append(round(sum((r["at"][k] - mean) ** 2 for r in rooms) / len(rooms), 9))
                up = spread.index(min(spread))
                out.append((f, rooms, [k for k in range(3) if k != up]))
        return out

    def from_to(self, a, b, axes):
        """Metres, and where b lies as seen from a."""
        du, dv = (b["at"][k] - a["at"][k] for k in axes)
        return math.hypot(du, dv), SECTORS[round(math.atan2(dv, du) / (math.pi / 4)) % 8]


def finish(lines):
    return "\n".join(lines).rstrip() + "\n"


def narrative(s):
    if not s.connected:
        return None
    floors, n = len({r["floor"] for r in s.rooms if r["floor"]}), sum(map(len, s.links.values())) // 2
    out = [f"{s.name} contains {len(s.rooms)} rooms{f' across {floors} floor' + 's' * (floors != 1) if floors else ''} and {len(s.objects)} objects."]
    out += [f"Room types: {s.types(s.rooms)}."] if s.types(s.rooms) else []
    out += [f"Rooms are connected by {n} room connection{'s' * (n != 1)} (doorways or open passages).", ""]
    for r in s.by_degree(s.rooms):
        near = s.by_degree([x for x in s.rooms if x["id"] in s.links[r["id"]]])
        out.append(s.label(r) + ("; connects to " + ", ".join(map(s.label, near)) if near else "") + f"; contains: {s.contents(r)}.")
    return finish(out)


def floors_of(s, out, body):
    groups = s.groups()
    for f, rooms, axes in groups:
        out += [""] + ([f"{'Floor ' + f if f else 'Unassigned floor'} ({len(rooms)} rooms):"] if len(groups) > 1 else [])
        body(rooms, axes)
    return finish(out)


def walked(s, head, line):
    out = [head]

    def body(rooms, axes):
        for r in s.by_degree(rooms):
            near = [next(x for x in rooms if x["id"] == i) for i in s.links[r["id"]] if any(x["id"] == i for x in rooms)]
            near = sorted(near, key=lambda x: s.from_to(r, x, axes)[0])
            out.append(f"{s.label(r)} — connected rooms:" if near else f"{s.label(r)} — no connected rooms (isolated).")
            out.extend(line(r, x, axes) for x in near)

    return floors_of(s, out, body)


def nearest(s, r, rooms, axes):
    return sorted((x for x in rooms if x is not r), key=lambda x: s.from_to(r, x, axes)[0])[:4]


def seen(s, r, x, axes):
    return f"  is {s.from_to(r, x, axes)[0]:.1f} m {s.from_to(x, r, axes)[1]} of {s.label(x)}."


def topology_metric(s):
    if len(s.placed) < 2 or not s.connected:
        return None
    head = f"{s.name} — {len(s.placed)} rooms. Room connections (doorways or open passages), with each room placed relative to each of its connected neighbours."
    return walked(s, head, lambda r, x, axes: seen(s, r, x, axes))


def navigation(s):
    if len(s.placed) < 2:
        return None
    if s.connected:
        head = f"{s.name} — {len(s.placed)} rooms. Routes by room connections (doorways or open passages)."
        return walked(s, head, lambda r, x, axes: "  you can walk to {}, {:.1f} m {}.".format(s.label(x), *s.from_to(r, x, axes)))
    out = [f"{s.name} — {len(s.placed)} rooms. Routes by proximity."]

    def body(rooms, axes):
        for r in sorted(rooms, key=lambda r: key(r["id"])):
            near = nearest(s, r, rooms, axes)
            out.extend([f"{s.label(r)} -- nearest neighbours:"] * bool(near))
            out.extend("  {}, {:.1f} m {} away.".format(s.label(x), *s.from_to(r, x, axes)) for x in near)

    return floors_of(s, out, body)


def metric_framing(s):
    if len(s.placed) < 2:
        return None
    out = [f"{s.name} -- {len(s.placed)} rooms. Each room's position stated relative to its 4 nearest same-floor neighbours."]

    def body(rooms, axes):
        for r in sorted(rooms, key=lambda r: key(r["id"])) if len(rooms) > 1 else []:
            out.append(f"{s.label(r)} -- nearest neighbours:")
            out.extend(seen(s, r, x, axes) for x in nearest(s, r, rooms, axes))

    return floors_of(s, out, body)


def metric_relations(s):
    if len(s.placed) < 2:
        return None
    groups, named = s.groups(), len({r["floor"] for r in s.rooms if r["floor"]})
    types = s.types([r for _, rooms, _ in groups for r in rooms])
    out = [f"{s.name} — {len(s.placed)} rooms{f', across {len(groups)} floors' if named >= 2 else ''}.{f' Room types: {types}.' if types else ''}"]
    which = "all neighbours" if max(len(rooms) for _, rooms, _ in groups) <= 5 else "each room's 4 nearest neighbours"

    def body(rooms, axes):
        out.extend(f"{s.label(r)} — contains: {s.contents(r)}." for r in sorted(rooms, key=lambda r: (-len(s.held(r)), key(r["id"]))))
        if len(rooms) > 1:
            out.extend(["", f"Spatial relations grouped by room ({which}, nearest first):"])
            for r in sorted(rooms, key=lambda r: key(r["id"])):
                out.append(f"{s.label(r)}:")
                out.extend(seen(s, r, x, axes) for x in nearest(s, r, rooms, axes))

    return floors_of(s, out, body)


def attribute(p):
    return p.startswith("same ") or p.endswith(" than")


def relations_subject(s):
    if not s.relations:
        return None
    rows = []
    for subject in {x for x, _, _ in s.relations}:
        own = [(p, o) for x, p, o in s.relations if x == subject]
        said = []
        for p in sorted({p for p, _ in own}, key=lambda p: (attribute(p), p)):
            to = [s.thing(o) for q, o in own if q == p]
            said.append(f"{p} {', '.join(to[:3] if attribute(p) else to)}" + (f" (+{len(to) - 3} more)" if attribute(p) and len(to) > 3 else ""))
        spatial = sum(not attribute(p) for p, _ in own)
        rows.append(((-spatial, -len(own), key(subject)), f"{s.thing(subject)}: {'; '.join(said)}."))
    head = f"{s.name} -- object relations grouped by object ({len(rows)} objects have outgoing relations)."
    return finish([head, "", *(t for _, t in sorted(rows))])


def clusters(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, done = [], set()
    for a in near:
        if a not in done:
            group, todo = {a}, [a]
            while todo:
                for b in near[todo.pop()] - group:
                    group.add(b)
                    todo.append(b)
            done |= group
            if len(group) > 1:
                out.append(sorted(group, key=key))
    return sorted(out, key=lambda g: (-len(g), key(g[0])))


def order(p):
    kinds = [p in SUPPORT, p in PROXIMITY, p in DIRECTIONAL, not attribute(p), True]
    return 4 if attribute(p) else kinds.index(True)


def relations_predicate(s):
    if not s.relations:
        return None
    counts, out = Counter(p for _, p, _ in s.relations), []
    for p in sorted(counts, key=lambda p: (order(p), -counts[p], p)):
        pairs = {(a, b) for a, q, b in s.relations if q == p}
        if p.startswith("same "):
            out += [f"{p}:", *("  {" + ", ".join(map(s.thing, g)) + "}" for g in clusters(pairs))]
        elif p in PROXIMITY:
            pairs = {tuple(sorted(x, key=key)) for x in pairs}
            out.append(f"{p}: " + "; ".join("{" + f"{s.thing(a)}, {s.thing(b)}" + "}" for a, b in sorted(pairs, key=lambda x: [key(i) for i in x])))
        else:
            out.append(f"{p}: " + "; ".join(f"{s.thing(a)} -> {s.thing(b)}" for a, b in sorted(pairs, key=lambda x: [key(i) for i in x])))
    return finish([f"{s.name} -- object relations grouped by relation type ({len(counts)} relation types).", "", *out])


def number(x):
    return round(x, 4)


def record(s):
    full = lambda d: {k: v for k, v in d.items() if v is not None and v != []}
    objects = lambda r: [full({"id": o["id"], "category": o["category"]}) for o in sorted(s.held(r), key=lambda o: key(o["id"]))]
    rooms = [full({"id": r["id"], "category": r["category"], "floor": r["floor"], "position": r["at"] and [number(x) for x in r["at"]], "objects": objects(r)}) for r in sorted(s.rooms, key=lambda r: key(r["id"]))]
    out = {"building": full({"name": s.name, "connectivity": {r["id"]: s.links[r["id"]] for r in s.rooms} if s.connected else None}), "rooms": rooms}
    return out | ({"relations": [{"subject": a, "predicate": p, "object": b} for a, p, b in s.relations]} if s.relations else {})


def graph(s):
    """What the digest says, from breadth-first searches with a room left out in turn."""
    near = {r["id"]: sorted(set(s.links.get(r["id"], [])), key=key) for r in s.rooms}
    place = {r["id"]: i for i, r in enumerate(s.rooms)}
    rooms = {r["id"]: r for r in s.rooms}

    def parts(without=None):
        out, done = [], {without}
        for a in sorted(near, key=place.get):
            if a not in done:
                group, todo = {a}, [a]
                while todo:
                    for b in near[todo.pop()]:
                        if b not in group and b != without:
                            group.add(b)
                            todo.append(b)
                done |= group
                out.append((a, group))
        return out

    def shown(ids):
        return ", ".join(s.label(r) for r in s.by_degree([rooms[i] for i in ids]))

    routes = []
    for a in near:
        paths, front = {a: [a]}, [a]
        while front:
            grown = {}
            for x in front:
                for y in near[x]:
                    if y not in paths:
                        grown[y] = min(grown.get(y, paths[x] + [y]), paths[x] + [y], key=lambda p: [key(i) for i in p])
            paths |= grown
            front = list(grown)
        routes += [(-len(p), key(a), key(b), p) for b, p in paths.items() if len(p) > 2 and key(a) < key(b)]
    return near, rooms, parts, shown, sorted(routes)


def graph_digest(s):
    if not s.connected:
        return None
    n = sum(map(len, s.links.values())) // 2
    head = f"{s.name} — {len(s.rooms)} rooms, {n} room connections (doorways or open passages). Connectivity digest (derived from the room connection graph; no metric data)."
    return finish([head, "", *digest(s)])


def digest(s):
    near, rooms, parts, shown, routes = graph(s)
    out = []
    groups = sorted(parts(), key=lambda g: (-len(g[1]), key(g[0])))
    out += ["Reachability: every room is reachable from every other (one connected group)." if len(groups) == 1 else f"Reachability: the rooms split into {len(groups)} separate groups — you cannot walk from one group to another.", ""]
    out += [f"Group {i} (1 room): {shown(g)} — isolated, no connections." if len(g) == 1 else f"Group {i} ({len(g)} rooms): {shown(g)}" for i, (_, g) in enumerate(groups, 1)]
    top = max(map(len, near.values()))
    hubs = sorted((i for i in near if len(near[i]) == top), key=key)
    out += ["", "Hub rooms (most connections): " + ", ".join(f"{s.label(rooms[i])} ({top} connections)" for i in hubs) + "."]
    cuts = []
    for r in s.by_degree(s.rooms):
        left = parts(r["id"])
        if len(left) > len(groups):
            beside = sorted((g for g in left if g[1] & set(near[r["id"]])), key=lambda g: (len(g[1]), key(g[0])))
            cuts.append(f"  {s.label(r)} — without it these become mutually unreachable: " + "  |  ".join("{" + shown(g) + "}" for _, g in beside))
    out += ["Bottlenecks (removing the room cuts its group apart):", *cuts] if cuts else ["Bottlenecks: none — no single room is a sole connector."]
    out += ["", *(["Distance between rooms (connections to cross; only multi-step pairs):"] if routes else [])]
    return [*out, *("  " + " -> ".join(s.label(rooms[i]) for i in p) for *_, p in routes)]


def branches(children, top, text, before="", lead=""):
    """A tree's lines, each child under its parent."""
    out = [before + lead + text(top)]
    inner = before + {"": "", "|-- ": "|   ", "`-- ": "    "}[lead]
    for i, child in enumerate(children.get(top, [])):
        out += branches(children, child, text, inner, "`-- " if i == len(children[top]) - 1 else "|-- ")
    return out


def room_tree(s):
    if not s.connected:
        return None
    near, rooms, parts, _, _ = graph(s)
    n = sum(map(len, near.values())) // 2
    out = [f"{s.name} — {len(rooms)} rooms, {n} room connections (doorways or open passages). Connectivity tree: rooms drawn as an indented tree; each room is listed under a room it directly connects to (indentation and branch lines show the connection).", ""]
    groups, drawn = sorted((sorted(g, key=key) for _, g in parts()), key=lambda g: (-len(g), key(g[0]))), set()

    def far(a):
        reach, front, steps = {a}, {a}, 0
        while front := {y for x in front for y in near[x]} - reach:
            reach |= front
            steps += 1
        return steps

    for i, group in enumerate(groups, 1):
        out += [f"Group {i} ({len(group)} rooms):"] if len(groups) > 1 else []
        centre = min(group, key=lambda a: (far(a), -len(near[a]), key(a)))
        children, todo, reached = {}, [centre], {centre}
        while todo:
            a = todo.pop(0)
            for b in near[a]:
                if b not in reached:
                    reached.add(b)
                    children.setdefault(a, []).append(b)
                    todo.append(b)
                    drawn |= {(a, b), (b, a)}
        out += [*branches(children, centre, lambda a: s.label(rooms[a]) + "  (isolated, no connections)" * (len(group) == 1)), ""]  # noqa: B023
    loops = sorted(((a, b) for a in near for b in near[a] if key(a) < key(b) and (a, b) not in drawn), key=lambda x: [key(i) for i in x])
    if loops:
        out += ["Additional connections (these close loops, so they are not drawn as branches above):", *(f"  {s.label(rooms[a])} -- {s.label(rooms[b])}" for a, b in loops)]
    return finish(out)


def forest(s):
    """child -> (parent, predicate), and the links beside it."""
    edges = {}
    for a, p, b in s.relations:
        if p in SUPPORT and a != b:
            edges[a, b] = min(p, edges.get((a, b), p))
    up = {a: min((b for x, b in edges if x == a), key=key) for a, _ in edges}
    cut = set()
    for a in up:
        walk = [a]
        while walk[-1] in up and up[walk[-1]] not in walk:
            walk.append(up[walk[-1]])
        if walk[-1] in up and min(walk, key=key) == a:
            cut.add(a)
    tree = {a: (b, edges[a, b]) for a, b in up.items() if a not in cut}
    return tree, [(a, p, b) for (a, b), p in edges.items() if tree.get(a, (None,))[0] != b]


def census(s, names):
    kinds = Counter(["support", "proximity", "directional", "other", "attribute"][order(p)] for _, p, _ in s.relations)
    return ", ".join(f"{kinds[k]} {text}" for k, text in names if kinds[k])


def relations_tree(s):
    if not s.relations:
        return None
    tree, beside = forest(s)
    children = {}
    for a in sorted(tree, key=key):
        children.setdefault(tree[a][0], []).append(a)
    out = [f"{s.name} -- support / containment structure drawn as an indented tree. Each object is listed under the one it sits on or is fixed to, and the parenthesised relation says how it attaches to that object above it -- e.g. 'wall [2] (attached to)' under 'floor [1]' means wall [2] is attached to floor [1].", ""]
    out += [] if tree else ["No support or containment relations to draw in this scene."]
    for top in sorted((a for a in children if a not in tree), key=key):
        out += [*branches(children, top, lambda a: s.thing(a) + (f" ({tree[a][1]})" if a in tree else "")), ""]
    if beside:
        out.append("Additional support links not drawn (a second base for an object, or one that would close a loop):")
        for a, p in sorted({(a, p) for a, p, _ in beside}, key=lambda x: (key(x[0]), x[1])):
            out.append(f"  {s.thing(a)} is also {p} " + ", ".join(s.thing(b) for x, q, b in sorted(beside, key=lambda x: key(x[2])) if (x, q) == (a, p)))
        out.append("")
    rest = census(s, [("proximity", "proximity (close by / next to)"), ("directional", "directional (left / right / front / behind)"), ("attribute", "comparative / shared-attribute (same ... / ... than)"), ("other", "other")])
    return finish([*out, *([f"Relations not shown in this support view: {rest}."] if rest else [])])


def facts(s):
    """The digest of a scene's relations."""
    tree, _ = forest(s)
    holders = Counter(b for b, _ in tree.values())
    chains = []
    for a in tree:
        if a not in holders:
            chain = [a]
            while chain[-1] in tree:
                chain.append(tree[chain[-1]][0])
            chains.append(chain)
    chains.sort(key=lambda c: (-len(c), key(c[0])))
    deep = [c for c in chains if len(c) > 2][:8]
    out = ["No support or containment relations in this scene."] if not tree else ["Support: every item sits directly on its base (nothing stacked deeper)."] if not deep else [f"Deepest support nesting: {len(deep[0]) - 1} levels.", "Support chains (deepest first):"]
    out += ["  " + " ".join(s.thing(a) + (f" ({tree[a][1]})" if a in tree else "") for a in c) for c in deep] + [""]
    if tree:
        top = sorted(holders, key=lambda b: (-holders[b], key(b)))[:5]
        out += ["Main receptacles (carry the most objects): " + ", ".join(f"{s.thing(b)} ({holders[b]} object{'s' * (holders[b] != 1)})" for b in top) + ".", ""]
    near = [(a, b) for a, p, b in s.relations if p in PROXIMITY]
    if near:
        found = clusters(near)
        out += [f"Proximity clusters ({len(found)} group{'s' * (len(found) != 1)} of objects near each other):", *("  {" + ", ".join(map(s.thing, g)) + "}" for g in found[:8]), ""]
    alike = sorted({p for _, p, _ in s.relations if p.startswith("same ")})
    if alike:
        out.append("Shared attributes (each group lists items sharing that property):")
        out += [f"  {p}: " + ", ".join(map(s.thing, g)) for p in alike for g in clusters([(a, b) for a, q, b in s.relations if q == p])] + [""]
    return [*out, "Relation census: " + census(s, [("support", "support/containment"), ("proximity", "proximity"), ("directional", "directional"), ("attribute", "comparative/shared-attribute"), ("other", "other")]) + "."]


def relations_digest(s):
    if not s.relations:
        return None
    return finish([f"{s.name} -- object-relation digest (derived from {len(s.relations)} relations; facts pre-computed, not the raw edge list).", "", *facts(s)])


def opening(s):
    floors, n = len({r["floor"] for r in s.rooms if r["floor"]}), sum(map(len, s.links.values())) // 2
    one = f"{s.name} is a single {s.rooms[0]['category'] or 'room'} containing {len(s.objects)} objects."
    many = f"{s.name} contains {len(s.rooms)} rooms{f' across {floors} floor' + 's' * (floors != 1) if floors else ''} and {len(s.objects)} objects."
    out = [one if len(s.rooms) == 1 else many] + ([f"Room types: {s.types(s.rooms)}."] if s.types(s.rooms) else [])
    return out + ([f"Rooms are connected by {n} room connection{'s' * (n != 1)} (doorways or open passages)."] if n else [])


def described(s, loose):
    def line(r):
        near = s.by_degree([x for x in s.rooms if x["id"] in s.links.get(r["id"], [])])
        n = len(s.held(r))
        return s.label(r) + ("; connects to " + ", ".join(map(s.label, near)) if near else "") + f"; contains {n} object{'s' * (n != 1)}: {s.contents(r)}."

    floors, out = sorted({r["floor"] for r in s.rooms if r["floor"]}), []
    if len(floors) < 2:
        return [loose + line(r) for r in s.by_degree(s.rooms)]
    for f in floors:
        here = s.by_degree([r for r in s.rooms if r["floor"] == f])
        out += [f"Floor {f} ({len(here)} rooms):", *("  " + line(r) for r in here), ""]
    return out + [loose + line(r) for r in s.by_degree([r for r in s.rooms if not r["floor"]])]


def stated(s, shared):
    own = [(a, p, b) for a, p, b in s.relations if not p.startswith("same ")]
    out = []
    for r in s.by_degree(s.rooms):
        rows = []
        for subject in {a for a, _, _ in own} & {o["id"] for o in s.held(r)}:
            mine, said = [(p, b) for a, p, b in own if a == subject], []
            for p in sorted({p for p, _ in mine}, key=lambda p: (attribute(p), p)):
                to = [s.thing(b) for q, b in mine if q == p]
                said.append(f"{p} {', '.join(to[:3] if attribute(p) else to)}" + (f" (+{len(to) - 3} more)" if attribute(p) and len(to) > 3 else ""))
            rows.append((-sum(not attribute(p) for p, _ in mine), -len(mine), key(subject), f"  {s.thing(subject)} is {'; '.join(said)}."))
        out += [f"{s.label(r)}:", *(t for *_, t in sorted(rows))] if rows else []
    if not out:
        return []
    alike = []
    for p in sorted({p for _, p, _ in s.relations if p.startswith("same ")}) if shared else []:
        for g in sorted(clusters([(a, b) for a, q, b in s.relations if q == p]), key=lambda g: key(g[0])):
            alike.append(f"  Same {p[5:]}: {', '.join(map(s.thing, g))}.")
    return ["", "Spatial relations by room:", *out] + (["", "  Shared attributes (each line lists items sharing that property):", *alike] if alike else [])


def prose(s):
    return finish([*opening(s), "", *described(s, ""), *stated(s, True)])


def synthesis(s):
    out = opening(s)
    if s.connected:
        out += ["", "Connectivity (derived from the room connection graph; no metric data):", *digest(s)]
    out += ["", "Rooms:", *described(s, "  ")]
    groups = s.groups() if len(s.placed) > 1 else []
    if any(len(rooms) > 1 for _, rooms, _ in groups):
        out += ["", "Salient metric relations (each room's 4 nearest neighbours, nearest first):"]
        for f, rooms, axes in groups:
            if len(rooms) > 1:
                out += [f"{'Floor ' + f if f else 'Unassigned floor'} ({len(rooms)} rooms):"] if len(groups) > 1 else []
                for r in sorted(rooms, key=lambda r: key(r["id"])):
                    out += [f"{s.label(r)}:", *(seen(s, r, x, axes) for x in nearest(s, r, rooms, axes))]
    out += stated(s, False)
    if s.relations:
        out += ["", "Derived object-relation structure (support depth, receptacles, proximity clusters, shared attributes, relation census):", *facts(s)]
    return finish(out)


@pytest.fixture(scope="module")
def scenes():
    return [Scene(n, random.Random(n)) for n in range(24)]


@pytest.fixture(scope="module")
def texts(spark, scenes):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "scenes": make([(s.id, s.name) for s in scenes], "scene_id string, name string"),
        "rooms": make([(s.id, r["id"], i, r["category"], r["floor"], *(r["at"] or (None,) * 3)) for s in scenes for i, r in enumerate(s.rooms)], "scene_id string, room_id string, room_ord int, category string, floor string, x double, y double, z double"),
        "objects": make([(s.id, o["room"], o["id"], i, o["short"], o["category"]) for s in scenes for i, o in enumerate(s.objects)], "scene_id string, room_id string, object_id string, obj_ord int, short_id string, category string"),
        "adjacency": make([(s.id, a, b, i) for s in scenes for a, near in s.links.items() for i, b in enumerate(near)], "scene_id string, src string, dst string, nbr_ord int"),
        "relations": make([(s.id, i, *r) for s in scenes for i, r in enumerate(s.relations)], "scene_id string, rel_ord int, subject_id string, predicate string, object_id string"),
    }
    shared = V._Scene(tables)
    return lambda rep: {r["scene_id"]: r["text"] for r in V.RENDERERS[rep](shared).collect()}


PLAIN = [narrative, topology_metric, navigation, metric_framing, metric_relations, relations_subject, relations_predicate, graph_digest, room_tree, relations_tree, relations_digest, prose, synthesis]


@pytest.mark.parametrize("plain", PLAIN, ids=lambda f: f.__name__)
def test_texts_equal_plain_ones(scenes, texts, plain):
    want = {s.id: plain(s) for s in scenes}
    got = texts(plain.__name__)
    assert got.keys() == {i for i, t in want.items() if t}
    for i, t in got.items():
        assert t == want[i], i


def test_records_equal_plain_ones(scenes, texts):
    mini, pretty = texts("json_mini"), texts("json_pretty")
    for s in scenes:
        want = record(s)
        assert mini[s.id] == json.dumps(want, separators=(",", ":"), ensure_ascii=False), s.id
        assert pretty[s.id] == json.dumps(want, indent=2, ensure_ascii=False)
