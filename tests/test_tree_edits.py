"""Edits of the node table against a plain tree, and fixes that are applied and audited again."""

import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from wardlume import queries_edits
from wardlume.operators import remediation, rules, tree_edits
from wardlume.sources.html import NODES, parse_pages
from wardlume.sources.staging import staged

EDITS = "doc_id long, " + ", ".join(f"{c} {t}" for c, t in tree_edits.FIELDS.items())


def table_of(spark, trees):
    """trees: {doc: {node: (parent, text)}} in reading order of siblings."""
    rows = []
    for doc, tree in trees.items():
        kids, order = {}, []
        for n, (up, _) in tree.items():
            kids.setdefault(up, []).append(n)

        def walk(n, path, order=order, kids=kids):
            order.append((n, path + [n]))
            for k in kids.get(n, []):
                walk(k, path + [n])

        walk(next(iter(tree)), [])
        wide = sorted(range(len(order)), key=lambda i: (len(order[i][1]), i))
        for i, (n, path) in enumerate(order):
            up = tree[n][0]
            rows.append((doc, n, up, "document" if up is None else "paragraph", i, wide.index(i), len(path) - 1, kids[up].index(n) if up is not None else 0, path, tree[n][1], {"k": "v"}))
    names = "doc_id node_id parent_id node_type dfs_pos bfs_pos depth sibling_pos path text props".split()
    df = spark.createDataFrame(rows, "doc_id long, node_id string, parent_id string, node_type string, dfs_pos int, bfs_pos int, depth int, sibling_pos int, path array<string>, text string, props map<string,string>")
    every = [c.split()[0] for c in NODES.replace("map<string,string>", "map").replace("array<string>", "array").split(", ")]
    kinds = dict(spark.createDataFrame([], NODES).dtypes)
    return staged(df.select(*[F.col(c) if c in names else F.lit(None).cast(kinds[c]).alias(c) for c in every]))


def in_order(tree):
    kids, out, todo = {}, [], [next(iter(tree))]
    for n, (up, _) in tree.items():
        kids.setdefault(up, []).append(n)
    while todo:
        out.append(todo.pop())
        todo += reversed(kids.get(out[-1], []))
    return out


def plain(trees, changes):
    """The edited trees: {doc: [(node, parent, path, depth, sibling place, text) in depth-first order]}, and {edit number: status}."""
    status = {}
    out = {}
    for doc, tree in trees.items():
        mine = [(i, e) for i, e in enumerate(changes) if e["doc_id"] == doc]
        paths = {}
        for n, (up, _) in tree.items():
            paths[n] = (paths[up] if up is not None else []) + [n]
        turn = {n: i for i, n in enumerate(in_order(tree))}
        place = {}
        for n, (up, _) in tree.items():
            place[n] = float(sum(1 for m in place if tree[m][0] == up))
        ok = []
        for i, e in mine:
            n, op = e["node_id"], e["op"]
            new_ok = any(x["new_id"] == n for _, x in mine if x["op"] in ("wrap", "insert"))
            bad = (op == "set" and n not in tree and not new_ok) or (op in ("wrap", "move", "drop") and (n not in tree or tree[n][0] is None)) or (op in ("move", "insert") and e["ref_id"] not in tree) or (
                op in ("wrap", "insert") and e["new_id"] in tree)
            status[i] = "refused" if bad else None
            ok += [] if bad else [(i, e)]
        gone, moved = ({e["node_id"] for _, e in ok if e["op"] == op} for op in ("drop", "move"))
        for i, e in list(ok):
            above = set(paths.get(e["node_id"], [])) - ({e["node_id"]} if e["op"] == "drop" else set())
            if above & gone or set(paths.get(e["ref_id"], [])) & gone or (e["op"] == "move" and set(paths[e["ref_id"]]) & moved):
                status[i] = "refused"
                ok.remove((i, e))
        best = {}
        for i, e in sorted(ok, key=lambda x: (x[1]["rank"], x[1]["action_code"])):
            thing = ("f", e["node_id"], e["field"]) if e["op"] == "set" else ("n", e["new_id"]) if e["op"] == "insert" else ("p", e["node_id"])
            status[i] = "superseded" if thing in best else "applied"
            best.setdefault(thing, (i, e))
        wraps = {}
        for i, e in best.values():
            if e["op"] == "wrap":
                wraps.setdefault(e["new_id"], []).append((place[e["node_id"]], i, e))
        parent, text = {n: t[0] for n, t in tree.items()}, {n: t[1] for n, t in tree.items()}
        for new, members in wraps.items():
            first = min(members, key=lambda m: turn[m[2]["node_id"]])
            home = tree[first[2]["node_id"]][0]
            for _, i, e in members:
                if tree[e["node_id"]][0] != home:
                    status[i] = "refused"
                else:
                    parent[e["node_id"]] = new
            parent[new], place[new], text[new] = home, first[0], None
        for i, e in best.values():
            if status[i] != "applied":
                continue
            if e["op"] == "move":
                parent[e["node_id"]], place[e["node_id"]] = e["ref_id"], e["place"] - 0.5
            elif e["op"] == "insert":
                parent[e["new_id"]], place[e["new_id"]], text[e["new_id"]] = e["ref_id"], e["place"] - 0.5, None
        for i, e in best.values():
            if e["op"] == "set":
                text[e["node_id"]] = e["value"]
        dropped = {e["node_id"] for i, e in best.values() if e["op"] == "drop"}
        rows, seen = [], {}

        def walk(n, path, rows=rows, parent=parent, place=place, text=text, dropped=dropped, seen=seen):
            if n in dropped:
                return
            rows.append((n, parent[n], tuple(path + [n]), len(path), seen.setdefault(parent[n], 0), text[n]))
            seen[parent[n]] += 1
            for k in sorted((k for k in parent if parent[k] == n), key=lambda k: (place[k], k)):
                walk(k, path + [n])

        walk(next(iter(tree)), [])
        out[doc] = rows
    return out, status


def random_case(rng, docs):
    trees, changes = {}, []
    for doc in range(docs):
        tree, names = {"n0": (None, "root")}, ["n0"]
        for i in range(1, rng.randrange(2, 25)):
            tree[f"n{i}"] = (rng.choice(names), f"t{i}")
            names.append(f"n{i}")
        trees[doc] = tree
        used = 0
        for _ in range(rng.randrange(0, 7)):
            e = dict.fromkeys(["doc_id", *tree_edits.FIELDS])
            op = rng.choice(["set", "wrap", "insert", "move", "drop", "set", "wrap"])
            e |= {"doc_id": doc, "op": op, "rank": rng.randrange(3), "action_code": f"A{len(changes)}", "node_id": rng.choice([*names, "none"])}
            if op == "set":
                e |= {"field": "text", "value": f"v{len(changes)}"}
            elif op == "wrap":
                e |= {"new_id": f"w{used // 2}", "node_type": "list"}
                used += 1
            elif op == "insert":
                e |= {"node_id": None, "new_id": f"i{len(changes)}", "node_type": "heading", "ref_id": rng.choice([*names, "none"]), "place": float(rng.randrange(4))}
            elif op == "move":
                e |= {"ref_id": rng.choice(names), "place": float(rng.randrange(4)) + 0.25}
            changes.append(e)
    return trees, changes


@pytest.mark.parametrize("seed", [1])
def test_random_edits_equal_a_plain_tree(spark, seed):
    trees, changes = random_case(random.Random(seed), 60)
    nodes = table_of(spark, trees)
    out, report = tree_edits.apply_edits(nodes, spark.createDataFrame([tuple(e[c] for c in ["doc_id", *tree_edits.FIELDS]) for e in changes], EDITS))
    expect, status = plain(trees, changes)
    said = {(r["action_code"]): (r["status"], r["note"]) for r in report.collect()}
    assert {e["action_code"]: status[i] for i, e in enumerate(changes)} == {k: v[0] for k, v in said.items()}
    assert all((n is not None) == (s == "refused") for s, n in said.values())
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["doc_id"], r["dfs_pos"])):
        got.setdefault(r["doc_id"], []).append(r)
    for doc, rows in expect.items():
        assert [(r["node_id"], r["parent_id"], tuple(r["path"]), r["depth"], r["sibling_pos"], r["text"]) for r in got[doc]] == rows
        assert [r["dfs_pos"] for r in got[doc]] == list(range(len(rows)))
        wide = sorted(got[doc], key=lambda r: (r["depth"], r["dfs_pos"]))
        assert [r["bfs_pos"] for r in wide] == list(range(len(rows)))


def test_nested_inserts_and_lost_ones(spark):
    nodes = table_of(spark, {1: {"n0": (None, "r"), "t": ("n0", "x"), "u": ("n0", "y")}})
    e = lambda **k: tuple((dict.fromkeys(tree_edits.FIELDS) | {"rank": 0, "action_code": "A"} | k)[c] for c in tree_edits.FIELDS)
    rows = [e(op="insert", new_id="row", node_type="table_row", ref_id="t", place=0.0), e(op="insert", new_id="c2", node_type="table_cell", ref_id="row", place=2.0), e(op="insert", new_id="c1", node_type="table_cell", ref_id="row", place=1.0),
            e(op="set", node_id="c2", field="text", value="Column 2"), e(op="insert", new_id="a", node_type="p", ref_id="b"), e(op="insert", new_id="b", node_type="p", ref_id="a"), e(op="set", node_id="a", field="text", value="x"),
            e(op="set", node_id="u", field="props.k"), e(op="set", node_id="u", field="props.m", value="1"), e(op="set", node_id="u", field="depth", value="9"), e(op="set", node_id="u", field="level", value="3"), e(op="sing", node_id="u")]
    out, report = tree_edits.apply_edits(nodes, spark.createDataFrame([(1, *r) for r in rows], EDITS))
    got = {r["node_id"]: r for r in out.collect()}
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1]["dfs_pos"])] == ["n0", "t", "row", "c1", "c2", "u"]
    assert got["c2"]["text"] == "Column 2" and got["c2"]["path"] == ["n0", "t", "row", "c2"]
    assert got["u"]["props"] == {"m": "1"} and got["u"]["level"] == 3 and got["u"]["depth"] == 1 and got["t"]["props"] == {"k": "v"}
    lost = sorted((r["op"], r["new_id"] or r["node_id"]) for r in report.filter("status = 'refused'").collect())
    assert lost == [("insert", "a"), ("insert", "b"), ("set", "a"), ("set", "u"), ("sing", "u")]


def test_no_edits_and_no_nodes(spark):
    nodes = table_of(spark, {1: {"n0": (None, "r")}})
    for n in (nodes, nodes.limit(0)):
        out, report = tree_edits.apply_edits(n, spark.createDataFrame([], EDITS))
        assert (out.count(), report.count()) == (n.count(), 0)


DIRTY = """<html><body><h1>Annual report</h1><p>It says what was done.</p><h3>Deep</h3><a href="https://data.example.gov/ops">click here</a>
<p>- expand the audit programme</p><p>- replace old forms</p><p>- publish the figures</p><p>Then came winter.</p><p>1. first</p><p>2. second</p><p>3) third</p><p>1986. It was long</p>
<img src=a.png title="Plan of the harbour"><table><tr><td>Name<td>Size<td>Price<tr><td>1.<td>2.<td>3.<tr><td>4<td>5<td>6</table><table><tr><td>1.5.<td>2<tr><td>3<td>4</table><ul><p>stray</p><li>x</ul>
<div>Email: <input name=email_address></div><span tabindex=3>x</span><p style="color:#999999;background:#fff">grey text here</p></body></html>"""


def test_fixes_are_applied_and_nothing_new_is_found(spark):
    clean = "<html lang=en><head><title>A real title</title></head><body><h1>Top</h1><p>Text</p></body></html>"
    nodes = staged(remediation.marked_fake_lists(parse_pages(spark.createDataFrame([(1, DIRTY), (2, clean), (3, DIRTY), (4, None)], "page_id long, html string"))))
    fixed, report, outcomes = remediation.remediated(nodes)
    by = {}
    for r in outcomes.collect():
        by.setdefault((r["doc_id"], r["outcome"]), []).append(r["rule_id"])
    assert {k[1] for k in by} <= {"fixed", "left"}
    assert set(by[1, "fixed"]) == {"HEADING_LEVEL_JUMP", "LINK_TEXT_NON_DESCRIPTIVE", "LIST_STRUCTURE_INVALID", "TABLE_MISSING_HEADERS", "TABLE_CAPTION_MISSING", "MISSING_ALT_TEXT", "DOCUMENT_TITLE_MISSING",
                                   "INPUT_AUTOCOMPLETE_MISSING", "POSITIVE_TABINDEX", "FORM_FIELD_UNLABELED", "LOW_CONTRAST_TEXT", "DOCUMENT_LANGUAGE_MISSING"}
    assert by[1, "fixed"].count("LIST_STRUCTURE_INVALID") == 3
    assert len(by.get((1, "left"), [])) < len(by[1, "fixed"]) and sorted(by[1, "fixed"]) == sorted(by[3, "fixed"])
    assert (2, "fixed") not in by and (2, "left") not in by
    # trees are whole: places, paths and kinds
    after = {}
    for r in sorted(fixed.filter("doc_id = 1").collect(), key=lambda r: r["dfs_pos"]):
        after[r["node_id"]] = r
    lists = [r for r in after.values() if r["node_type"] == "list"]
    assert [(x["ordered"], [c["text"] for c in after.values() if c["parent_id"] == x["node_id"]]) for x in lists] == [
        (False, ["expand the audit programme", "replace old forms", "publish the figures"]), (True, ["first", "second", "third"]), (False, [None, "x"])]
    first, second = (x for x in after.values() if x["node_type"] == "table")
    rows = lambda t: [[c["text"] for c in after.values() if c["parent_id"] == r["node_id"]] for r in after.values() if r["parent_id"] == t["node_id"]]
    assert rows(first)[0] == ["Name", "Size", "Price"] and rows(second)[0] == ["Column 1", "Column 2"] and len(rows(second)) == 3
    assert {c["cell_type"] for c in after.values() if c["text"] in ("Name", "Column 1")} == {"header"}
    for r in after.values():
        assert r["path"] == ([*after[r["parent_id"]]["path"], r["node_id"]] if r["parent_id"] else [r["node_id"]])
    assert report.filter("status = 'refused'").count() == 0
    scores = {r["doc_id"]: (r["issues"], r["fixed"]) for r in remediation.confirmed_scores(nodes.select("doc_id").distinct(), outcomes).collect()}
    assert scores[1] == (len(by[1, "fixed"]) + len(by.get((1, "left"), [])), len(by[1, "fixed"])) and scores[2] == (0, 0)


def test_only_the_chosen_actions(spark):
    nodes = staged(remediation.marked_fake_lists(parse_pages(spark.createDataFrame([(1, DIRTY)], "page_id long, html string"))))
    _, report, outcomes = remediation.remediated(nodes, ["NORMALIZE_HEADING_LEVEL", "FIX_LIST_STRUCTURE"])
    assert {r["rule_id"] for r in outcomes.filter("outcome = 'fixed'").collect()} == {"HEADING_LEVEL_JUMP", "LIST_STRUCTURE_INVALID"}
    assert {r["action_code"] for r in report.collect()} == {"NORMALIZE_HEADING_LEVEL", "FIX_LIST_STRUCTURE"}
    assert rules.audit(nodes).count() == outcomes.filter("outcome <> 'new'").count()


def _written_plans(spark, monkeypatch, run):
    """The plans of what a call writes."""
    plans = []
    monkeypatch.setattr(tree_edits, "staged", lambda df, name="staged": plans.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, name))
    run()
    return plans


def test_nodes_and_edits_meet_without_joins(spark, monkeypatch):
    """Joined by name, the millions of edits of small documents looked small and were broadcast through the driver."""
    nodes = table_of(spark, {1: {"n0": (None, "r"), "t": ("n0", "x"), "u": ("n0", "y")}})
    rows = [("wrap", "t", "w", None), ("move", "u", None, "t"), ("insert", None, "i", "t"), ("set", "t", None, None), ("drop", "none", None, None)]
    changes = spark.createDataFrame([(1, *[{"op": o, "node_id": n, "new_id": new, "ref_id": ref, "rank": 0, "place": 0.0, "field": "text", "action_code": "A"}.get(c) for c in tree_edits.FIELDS]) for o, n, new, ref in rows], EDITS)
    plans = _written_plans(spark, monkeypatch, lambda: tree_edits.apply_edits(nodes, changes))
    assert len(plans) == 2 and not any("Join" in p or "Broadcast" in p for p in plans)


def test_outcomes_of_edits_write_no_edited_tree(spark, monkeypatch):
    plans = _written_plans(spark, monkeypatch, lambda: queries_edits.edit_outcomes(spark, SF))
    assert len(plans) == 1


def test_typed_lists_are_marked_where_they_lie(spark):
    """Runs were joined with all nodes, and paragraphs with all parents; now two windows over nodes dealt by document tell them."""
    tree = {"n0": (None, "r"), "a": ("n0", "- one"), "b": ("n0", "- two"), "c": ("n0", "* three"), "d": ("n0", "1. x"), "e": ("n0", "2. y"), "f": ("e", "- child"), "g": ("n0", "3. z"), "h": ("n0", "1) p"), "i": ("n0", "2) q")}
    nodes = table_of(spark, {1: tree})
    marked = remediation.marked_fake_lists(nodes)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    got = {r["node_id"]: r["props"]["fake_list_run_ids"] for r in marked.collect() if "fake_list_run_ids" in r["props"]}
    assert got == {"a": "a b", "h": "h i"} and marked.count() == len(tree)
    assert {r["node_id"]: r["first_id"] for r in remediation.fake_list_members(nodes).collect()} == {"a": "a", "b": "a", "h": "h", "i": "h"}


def test_audits_are_compared_by_one_shuffle(spark):
    rows = [(1, "a", "R", "warning"), (1, "a", "R", "warning"), (1, "b", "R", "warning")], [(1, "b", "R", "warning"), (2, "c", "S", "error")]
    before, after = (spark.createDataFrame(r, "doc_id long, node_id string, rule_id string, severity string") for r in rows)
    x = remediation.compared_audits(before, after)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert sorted(tuple(r) for r in x.collect()) == [(1, "a", "R", "warning", "fixed"), (1, "b", "R", "warning", "left"), (2, "c", "S", "error", "new")]


def test_fixes_of_what_is_not_there_are_not_planned(spark, monkeypatch):
    def never(nodes):
        raise AssertionError

    for name in ("_table_edits", "_order_edits", "_heading_edits"):
        monkeypatch.setattr(remediation, name, never)
    nodes = table_of(spark, {1: {"n0": (None, "r"), "a": ("n0", "words")}})
    assert remediation._present(nodes) == set()
    fixed, report = remediation.apply_fixes(nodes, ["FIX_LIST_STRUCTURE", "ADD_TABLE_HEADERS"])
    assert (fixed.count(), report.count()) == (2, 0)
