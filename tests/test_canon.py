"""Promotion against one fold over all items, versioned tables under interruption, and components."""

from __future__ import annotations

import hashlib
import random

import pytest

from folium.operators import canon, graph
from folium.sources import versions

ITEM = "item_id bigint, kind string, revision int, status string, availability string, subject string, partner string, aliases array<string>, notes array<string>"
ROW = "kind string, subject string, partner string, aliases array<string>, notes array<string>, position bigint"
RESOLUTION = "conflict_id string, resolution string"
norm = lambda s: " ".join((s or "").lower().split())


def conflict_name(item, kind, target):
    return "conflict-" + hashlib.sha256(f"{item['item_id']}\0{item['revision']}\0{kind}\0{target}".encode()).hexdigest()


def one_fold(items, rows, resolutions, state_too=False):
    """All items in turn over plain lists: (item_id, what, action or kind, target, resolution, refused)."""
    profiles = [dict(r, aliases=None) for r in rows if r["kind"] == "character"]
    aliases = [(r["subject"], a) for r in rows if r["kind"] == "character" for a in r["aliases"]]
    pairs = [r for r in rows if r["kind"] == "relationship"]
    terms = [r for r in rows if r["kind"] == "terminology"]
    out = []

    def owner(name):
        for p in profiles:
            if norm(p["subject"]) == norm(name):
                return p["subject"]
        return next((o for o, a in aliases if norm(a) == norm(name)), None)

    for item in sorted(items, key=lambda x: x["item_id"]):
        if item["status"] not in ("approved", "edited") or item["kind"] == "literary":
            continue
        if item["availability"] == "obsolete":
            out.append((item["item_id"], "conflict", "StaleProposal", str(item["item_id"]), None, False))
            continue
        state = {"open": False, "cancelled": False}

        def ask(kind, target, allowed, item=item, state=state):
            way = resolutions.get(conflict_name(item, kind, target))
            refused = way is not None and way not in allowed
            way = None if refused else way
            out.append((item["item_id"], "conflict", kind, target, way, refused))
            state["open"] |= way is None
            state["cancelled"] |= way == "cancel_promotion"
            return way

        full = ("keep_canon", "use_reviewed_proposal", "merge", "cancel_promotion")
        subject, notes = item["subject"], [n or "" for n in item["notes"]]
        if item["kind"] == "character":
            who = owner(subject)
            if who is not None and norm(who) != norm(subject):
                ask("CharacterIdentity", subject, ("cancel_promotion",))
                continue
            at = next((i for i, p in enumerate(profiles) if norm(p["subject"]) == norm(subject)), None)
            held = [a for o, a in aliases if norm(o) == norm(subject)]
            final, names, action = (subject, notes), item["aliases"], "insert"
            if at is not None:
                final, names, action = (profiles[at]["subject"], profiles[at]["notes"]), held, "keep_canon"
                if {norm(a) for a in held} != {norm(a) for a in item["aliases"]} or final[1] != notes:
                    way = ask("CharacterProfile", subject, full)
                    if way == "use_reviewed_proposal":
                        final, names, action = (subject, notes), item["aliases"], "replace"
                    elif way == "merge":
                        final, names, action = (final[0], [a if a.strip() else b for a, b in zip(final[1], notes, strict=True)]), held + item["aliases"], "merge"
            if state["open"] or state["cancelled"]:
                continue
            accepted = []
            for a in names:
                if norm(a) != norm(subject) and norm(a) not in map(norm, accepted):
                    who = owner(a)
                    if who is not None and norm(who) != norm(subject):
                        if all(x[3] != a or x[0] != item["item_id"] or x[2] != "CharacterAliasCollision" for x in out):
                            seen = [x for x in names[: names.index(a)] if norm(x) == norm(a)]
                            if not seen:
                                ask("CharacterAliasCollision", a, ("keep_canon", "cancel_promotion"))
                    else:
                        accepted.append(a)
            if state["open"] or state["cancelled"]:
                continue
            if at is None:
                profiles.append({"subject": final[0], "notes": final[1]})
            else:
                profiles[at] = {"subject": final[0], "notes": final[1]}
            if {norm(a) for a in accepted} != {norm(a) for a in held}:
                aliases[:] = [x for x in aliases if norm(x[0]) != norm(subject)] + [(final[0], a) for a in accepted]
            out.append((item["item_id"], "operation", action, "character:" + norm(subject), ("|".join(final[1]), ",".join(accepted)), False))
        elif item["kind"] == "relationship":
            key = sorted((norm(subject), norm(item["partner"])))
            at = next((i for i, p in enumerate(pairs) if sorted((norm(p["subject"]), norm(p["partner"]))) == key), None)
            final, action = notes, "insert"
            if at is not None:
                final, action = pairs[at]["notes"], "keep_canon"
                if final != notes:
                    way = ask("RelationshipContradiction", f"{subject}↔{item['partner']}", full)
                    if way == "use_reviewed_proposal":
                        final, action = notes, "replace"
                    elif way == "merge":
                        final, action = [b if not a.strip() else a if not b.strip() or a == b else f"{a.strip()}; {b.strip()}" for a, b in zip(final, notes, strict=True)], "merge"
            if state["open"] or state["cancelled"]:
                continue
            new = {"subject": subject, "partner": item["partner"], "notes": final}
            if at is None:
                pairs.append(new)
            else:
                pairs[at] = new
            out.append((item["item_id"], "operation", action, "relationship:" + "↔".join(key), ("|".join(final), ""), False))
        else:
            own = [i for i, t in enumerate(terms) if norm(t["subject"]) == norm(subject)]
            final, action = notes, "insert"
            if own:
                first, split = terms[own[0]]["notes"], len({norm(terms[i]["notes"][0]) for i in own}) > 1
                if not split and norm(first[0]) == norm(notes[0]) and first[1] == notes[1]:
                    action = "keep_canon"
                else:
                    way = ask("GlossaryTranslation", subject, ("use_reviewed_proposal", "cancel_promotion") if split else ("keep_canon", "use_reviewed_proposal", "cancel_promotion"))
                    final, action = (first, "keep_canon") if way == "keep_canon" else (notes, "replace")
            if state["open"] or state["cancelled"]:
                continue
            if own:
                for i in reversed(own):
                    del terms[i]
            terms.insert(own[0] if own else len(terms), {"subject": subject, "notes": final})
            out.append((item["item_id"], "operation", action, "glossary:" + norm(subject), ("|".join(final), ""), False))
    people = [(p['subject'], tuple(p['notes']), tuple(a for o, a in aliases if norm(o) == norm(p['subject']))) for p in profiles]
    rest = [(x['subject'], x.get('partner'), tuple(x['notes'])) for x in pairs + terms]
    return (sorted(out, key=repr), sorted(map(repr, people + rest))) if state_too else sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    name = lambda: rng.choice(["Ann", "ann", "Bob", "Cy", "Dee", "Eve", "Flo"])
    note = lambda: rng.choice(["x", "y", " ", ""])
    rows, seen = [], set()
    for i in range(6):
        kind = rng.choice(["character", "relationship", "terminology"])
        a, b = rng.sample(["Ann", "Bob", "Cy", "Dee"], 2)
        key = (kind, a) if kind != "relationship" else (kind, *sorted((a, b)))
        if key in seen and kind != "terminology":
            continue
        seen.add(key)
        nick = [f"Nick {a}"] if kind == "character" and rng.random() < 0.5 else []
        rows.append({"kind": kind, "subject": a, "partner": b if kind == "relationship" else None, "aliases": nick, "notes": [note() for _ in range(3 if kind == "relationship" else 2)], "position": i})
    items, resolutions = [], {}
    for i in range(40):
        kind = rng.choice(["character", "character", "relationship", "terminology", "literary"])
        a = name()
        b = rng.choice([n for n in ("Bob", "Cy", "Dee", "EVE") if norm(n) != norm(a)])
        item = {
            "item_id": i * 3, "kind": kind, "revision": rng.randint(1, 3), "status": rng.choice(["approved", "edited", "approved", "pending", "applied"]), "availability": rng.choice(["active"] * 9 + ["obsolete"]),
            "subject": a, "partner": b if kind == "relationship" else None, "aliases": [rng.choice(["Nick Ann", "nick ann", "Bob", "Zed", "Nick Cy", a]) for _ in range(rng.randint(0, 3))] if kind == "character" else [], "notes": [note() for _ in range(3 if kind == "relationship" else 2)],
        }
        items.append(item)
        ways = ["keep_canon", "use_reviewed_proposal", "use_reviewed_proposal", "merge", "cancel_promotion"]
        for conflict, target in (("CharacterProfile", a), ("CharacterIdentity", a), ("GlossaryTranslation", a), ("RelationshipContradiction", f"{a}↔{b}"), *[("CharacterAliasCollision", x) for x in item["aliases"]]):
            if rng.random() < 0.7:
                resolutions[conflict_name(item, conflict, target)] = rng.choice(ways)
    return items, rows, resolutions


def frames(spark, items, rows, resolutions):
    as_rows = lambda dicts, schema: spark.createDataFrame([tuple(x[c.split()[0]] for c in schema.split(", ")) for x in dicts], schema)
    return as_rows(items, ITEM), as_rows(rows, ROW), spark.createDataFrame(list(resolutions.items()), RESOLUTION)


def test_fold_by_components_equals_one_fold(spark):
    """Twenty worlds side by side; names of one world don't meet those of another."""
    items, rows, resolutions, want = [], [], {}, []
    for w in range(20):
        i, r, s = made(w)
        rename = lambda x, w=w: x if x is None else f"{x} {w}"
        for x in i:
            old = dict(x)
            x.update(item_id=x["item_id"] * 100 + w, subject=rename(x["subject"]), partner=rename(x["partner"]), aliases=[rename(a) for a in x["aliases"]])
            for kind, a, b in (("CharacterProfile", old["subject"], x["subject"]), ("CharacterIdentity", old["subject"], x["subject"]), ("GlossaryTranslation", old["subject"], x["subject"]), ("RelationshipContradiction", f"{old['subject']}↔{old['partner']}", f"{x['subject']}↔{x['partner']}"), *[("CharacterAliasCollision", p, q) for p, q in zip(old["aliases"], x["aliases"], strict=True)]):
                if (way := s.get(conflict_name(old, kind, a))) is not None:
                    resolutions[conflict_name(x, kind, b)] = way
        for x in r:
            x.update(subject=rename(x["subject"]), partner=rename(x["partner"]), aliases=[rename(a) for a in x["aliases"]])
        items, rows = items + i, rows + r
    want = one_fold(items, rows, resolutions)
    events = canon.plan(*frames(spark, items, rows, resolutions)).collect()
    got = sorted(((e["item_id"], e["what"], e["action"] or e["conflict"], e["target"], ("|".join(e["after"]["notes"]), ",".join(e["after"]["aliases"] or [])) if e["what"] == "operation" else e["resolution"], e["refused"]) for e in events), key=repr)
    assert got == want
    assert {e["conflict"] for e in events} >= {canon.IDENTITY, canon.ALIAS, canon.PROFILE, canon.TRANSLATION, canon.CONTRADICTION, canon.STALE} and any(e["refused"] for e in events)


def test_selected_items_and_edges(spark):
    rows = [(1, "literary", 1, "approved", "active", "s", "tone", [], ["a", "b"]), (2, "terminology", 1, "applied", "active", "t", None, None, ["a", None]), (3, "terminology", 1, "rejected", "active", "t", None, None, ["a", "b"]), (4, "terminology", 2, "edited", "active", "T", None, None, ["a", None]), (5, "character", 1, "approved", "active", None, None, None, [None, None])]
    items, empty = spark.createDataFrame(rows, ITEM), (spark.createDataFrame([], ROW), spark.createDataFrame([], RESOLUTION))
    events = canon.plan(items, *empty, items)
    assert {r["item_id"]: r["outcome"] for r in canon.outcomes(events, items).collect()} == {1: "blocked", 2: "applied", 3: "refused", 4: "promoted", 5: "promoted"}
    facts = canon.summary(events, empty[0]).first()
    assert facts["blocked"] and facts["refused"] and facts["operations"] == 2
    assert canon.plan(items.limit(0), *empty).count() == 0
    again = canon.plan(items.repartition(5), *empty, items)
    assert canon.summary(again, empty[0]).first()["plan_id"] == facts["plan_id"]


def test_rows_of_the_canon_dont_meet_resolutions(spark):
    """They have no item id, so a join by it would bring all of them to one task."""
    plan = canon.plan(*frames(spark, *made(3)))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    by_item = [i for i, line in enumerate(plan) if "Join LeftOuter, (item_id" in line]
    assert by_item
    for i in by_item:
        end = next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(plan[i])), len(plan))
        assert not any("Union" in line for line in plan[i + 1 : end])


@pytest.mark.parametrize("seed", [5])
def test_promoted_items_plan_the_same_without_the_others(spark, seed):
    items, rows, resolutions = frames(spark, *made(seed))
    ready = items.filter("status IN ('approved', 'edited') AND kind <> 'literary'")
    events = canon.plan(items, rows, resolutions)
    fit = canon.outcomes(events, ready).filter("outcome = 'promoted'")
    alone = canon.plan(items, rows, resolutions, fit)
    assert sorted(map(repr, canon.promotable(events, ready).collect())) == sorted(map(repr, alone.collect())) != []


@pytest.mark.parametrize("step", versions.STEPS)
def test_a_stopped_writer_leaves_the_old_or_the_new_version(spark, tmp_path, step):
    store = versions.Store(spark, f"file://{tmp_path}/store")
    one, two = spark.range(3), spark.range(5)
    assert store.commit("a", None, {"t": one, "u": one}) == "applied"
    old = store.current()["tables"]["t"]["fingerprint"]
    with pytest.raises(versions.Interrupted):
        store.commit("b", {"t": old}, {"t": two}, stop_after=step)
    reader = versions.Store(spark, f"file://{tmp_path}/store")
    assert reader.read("t").count() == (5 if step == "pointer" else 3) and reader.read("u").count() == 3
    assert reader.recover() == ("completed" if step == "pointer" else "rolled_back") and reader.recover() == "clean"
    assert reader.commit("b", None if step == "pointer" else {"t": old}, {"t": two}) == ("already_applied" if step == "pointer" else "applied")
    assert reader.read("t").count() == 5 and reader.current()["number"] == 2
    assert reader.commit("b", {"t": "anything"}, {"t": one}) == "already_applied" and reader.read("t").count() == 5
    with pytest.raises(versions.Stale):
        reader.commit("c", {"t": old}, {"t": one})
    with pytest.raises(KeyError):
        reader.read("nothing")


@pytest.mark.parametrize("seed", [3, 7])
def test_applied_plans_leave_the_canon_as_the_fold_does(spark, seed):
    items, rows, resolutions = made(seed)
    tables = frames(spark, items, rows, resolutions)
    ready = tables[0].filter("status IN ('approved', 'edited') AND kind <> 'literary'")
    fit = canon.outcomes(canon.plan(*tables), ready).filter("outcome = 'promoted'")
    after = canon.apply(canon.plan(*tables, fit), tables[1]).collect()
    people = [(r["subject"], tuple(r["notes"]), tuple(r["aliases"])) for r in after if r["kind"] == "character"]
    rest = [(r["subject"], r["partner"], tuple(r["notes"])) for r in after if r["kind"] != "character"]
    assert sorted(map(repr, people + rest)) == one_fold(items, rows, resolutions, state_too=True)[1]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3), (7000, 6999), (6999, 7001)] + [(rng.randint(9000, 9400), rng.randint(9000, 9400)) for _ in range(150)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
