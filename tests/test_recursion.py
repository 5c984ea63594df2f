import random

from codekiln.operators import ast_nodes

SCHEMA = "file_id string, node_id long, parent_id long, ordinal int, depth int, pre long, last long, kind string, spelling string, line int"


def _random_tree(file, rng, n):
    parents = [None] + [rng.randrange(max(0, k - 4), k) for k in range(1, n)]
    children = {k: [c for c in range(n) if parents[c] == k] for k in range(n)}
    rows = []

    def walk(k, depth):
        me = len(rows)
        rows.append([file, k, parents[k], 0, depth, me, me, rng.choice(["FUNCTION_DECL", "CALL_EXPR", "IF_STMT", "CXX_METHOD"]), rng.choice(["f", "g", None]), 1])
        for c in children[k]:
            walk(c, depth + 1)
        rows[me][6] = len(rows) - 1

    walk(0, 0)
    return [tuple(r) for r in rows]


def test_innermost_function_as_by_hand(spark):
    rng = random.Random(5)
    rows = [r for k in range(30) for r in _random_tree(f"t{k}", rng, 40)]
    nodes = ast_nodes.prepared(spark.createDataFrame(rows, SCHEMA))
    got = {tuple(r) for r in ast_nodes.recursive_calls(nodes).select("file_id", "identifier", "node_id").collect()}
    want = set()
    for file, node, _, _, _, pre, _, kind, name, _ in rows:
        around = [r for r in rows if r[0] == file and r[5] < pre <= r[6] and r[7] in ast_nodes.FUNCTIONS]
        if kind == "CALL_EXPR" and name and around and max(around, key=lambda r: r[5])[8] == name:
            want.add((file, name, node))
    assert got == want and want


def test_no_nodes_no_calls(spark):
    assert ast_nodes.recursive_calls(ast_nodes.prepared(spark.createDataFrame([], SCHEMA))).count() == 0
