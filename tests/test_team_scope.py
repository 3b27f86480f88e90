from wardlume.operators import dashboards

MEMBERS = [(1, 10), (2, 10), (2, 10), (3, 20), (4, 20), (4, 10), (5, None), (None, 20)]
TEAMS = [(10, 9), (20, 9), (30, 7), (None, 6)]
USERS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, None]


def _scope(spark):
    return dashboards.team_scope(spark.createDataFrame(MEMBERS, "user_id long, team_id long"), spark.createDataFrame(TEAMS, "team_id long, owner_id long"), spark.createDataFrame([(u,) for u in USERS], "user_id long"))


def test_pairs_are_whole_and_once_each(spark):
    own = {(u, t) for u, t in MEMBERS if t} | {(o, t) for t, o in TEAMS if t}
    want = {(a, b) for a, t in own for b, s in own if t == s} | {(u, u) for u in USERS}
    got = [tuple(r) for r in _scope(spark).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_viewers_with_one_team_are_not_shuffled(spark):
    """A step that removes repeats above all pairs would shuffle the squares of the teams."""
    top = _scope(spark)._jdf.queryExecution().optimizedPlan()
    assert top.nodeName() == "Union"
    parts = [top.children().apply(i) for i in range(top.children().size())]
    assert len(parts) == 3 and "Aggregate [user_id" not in parts[0].toString().splitlines()[0]
