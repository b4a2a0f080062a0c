"""Queries against their SQL on small tables of cases that the given tables hold only when they are large."""

import re
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import SF, plain

from tessera.functions import bounded
from tessera.operators import context, graph, history, metrics
from tessera.plans import carriers
from tessera.plans.queries import ORACLE_SQL, QUERIES
from tessera.streaming import intake


def against_sql(spark, name, folder):
    """The rows of a query, after they were compared with those of its SQL."""
    duck = duckdb.connect()
    for f in folder.glob("*.parquet"):
        duck.execute(f"create view {f.stem} as select * from '{f}'")
    got = QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    said = duck.execute(ORACLE_SQL[name])
    at = [[d[0] for d in said.description].index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[k]) for k in at) for r in said.fetchall()), key=repr)
    return mine


@pytest.mark.parametrize("name", ["session_checks", "session_messages"])
def test_last_half_second_of_a_day(spark, tmp_path, name):
    ends = ["23:59:59.499999", "23:59:59.5", "23:59:59.7", "23:59:58.5"]
    rows = ", ".join(f"({10 * day + k}, timestamp '2024-01-{day:02d} {end}', {k % 2}, 'view', 1.0, '')" for day in range(3, 14) for k, end in enumerate(ends))
    duckdb.execute(f"copy (select * from (values {rows}) as t(event_id, ts, user_id, event_type, value, props)) to '{tmp_path}/events.parquet'")
    assert against_sql(spark, name, tmp_path)


def test_titles_of_the_same_terms_meet_a_prompt_once(spark):
    """What meets on the way doesn't grow with prompts x titles: 300 prompts and 200 copies of three titles."""
    prompts = spark.range(300).selectExpr("id as prompt_id", "concat('old rod number', id % 7) as prompt")
    titles = spark.range(600).selectExpr("concat('d', id) as id", "element_at(array('an old rod', 'the new rod', 'old bolt'), cast(id % 3 + 1 as int)) as title")
    matched = intake.prompt_matches(prompts, (), titles)
    folder = tempfile.mkdtemp()
    matched.write.parquet(f"{folder}/out")
    store = spark.sparkContext._jsc.sc().statusStore()
    assert spark.read.parquet(f"{folder}/out").count() == 300 * 200
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0), None)
    last = max(stages.apply(k).stageId() for k in range(stages.size()) if stages.apply(k).outputRecords() == 60000)
    assert sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()) if last - 12 < stages.apply(k).stageId() < last) < 6000


def shuffled(spark, run):
    """Bytes that stages write to shuffles while run() runs."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        stages = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_terms_of_a_prompt_are_not_dealt_with_it(spark, tmp_path):
    """A prompt is shuffled as its text and as a row for each list of titles that it matches, not with each of its terms and the classes that these meet."""
    titles = spark.range(320).selectExpr("concat('d', id) as id", "concat('word', id % 8, 'x thing', id % 64 div 8) as title")
    prompts = spark.range(30000).selectExpr("id as prompt_id", "concat('please look again into every word', id % 8, 'x thing', id % 64 div 8) as prompt")
    assert shuffled(spark, lambda: intake.prompt_matches(prompts, (), titles).write.parquet(str(tmp_path / "out"))) < 35 * 30000
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30000 * 5


def test_shuffles_of_settled_steps_are_deleted(spark):
    """What a prompt is shuffled as is gone once it is settled, so shuffle files don't add up over the steps."""
    trackers = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    spark.sparkContext._jvm.System.gc()
    before = trackers.shuffleStatuses().size()
    prompts = spark.range(300).selectExpr("id as prompt_id", "concat('old rod number', id % 7) as prompt")
    titles = spark.range(60).selectExpr("concat('d', id) as id", "'an old rod' as title")
    kept = intake.prompt_matches(prompts, (), titles)
    assert trackers.shuffleStatuses().size() <= before + 1 and kept.count() == 300 * 60
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_matches_are_opened_list_by_list(spark, monkeypatch, tmp_path):
    """A class of titles comes in lists and its prompts in groups, and what a partition opens is bounded; so rows of a file repeat the ids of a few lists. No pair is lost at their ends."""
    for name, most in (("LISTED", 50), ("MEETING", 100), ("OPENED", 10000)):
        monkeypatch.setattr(intake, name, most, raising=False)
    titles = spark.range(600).selectExpr("concat('d', id) as id", "element_at(array('an old rod', 'the new rod', 'old bolt'), cast(id % 3 + 1 as int)) as title")
    prompts = spark.range(1500).selectExpr("id as prompt_id", "element_at(array('old rod', 'every new rod', 'one old bolt', 'old new rod', 'old'), cast(id % 5 + 1 as int)) as prompt")
    intake.prompt_matches(prompts, (), titles).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("file", F.input_file_name())
    kinds = [(0,), (1,), (2,), (0, 1), ()]
    rows = {(r.prompt_id, r.id) for r in got.collect()}
    assert rows == {(p, f"d{k}") for p in range(1500) for kind in kinds[p % 5] for k in range(kind, 600, 3)} and got.count() == len(rows)
    files = [(r.n, r.runs) for r in got.groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("id").alias("runs")).collect()]
    assert max(n for n, _ in files) < 60000 and min(runs for _, runs in files) < 300


def test_prompts_of_one_key_are_one(spark, tmp_path):
    """Keys that come twice, with the same terms or others, and a null one, as the SQL has them."""
    rows = "(40, 'old rod', 7, 'PROMO', 3), (40, 'old bolt', 7, 'PROMO', 3), (80, 'old gear', 8, 'LARGE', 6), (1, 'old ring', 3, 'SMALL', 2), (1, 'blue rod', 4, 'SMALL', 2), (2, 'old ring', 3, 'SMALL', 2), (2, 'old ring', 3, 'SMALL', 2), (null, 'old rod', 3, 'LARGE', 9), (3, 'rod gear', 1, 'SMALL', 4)"
    duckdb.execute(f"copy (select k::bigint as p_partkey, name as p_name, 'Brand#' || b as p_brand, kind as p_type, size::int as p_size from (values {rows}) as t(k, name, b, kind, size)) to '{tmp_path}/part.parquet'")
    found = against_sql(spark, "prompt_targets", tmp_path)
    assert len(found) == len(set(found))


def test_components_are_matched_once_a_file(spark):
    """Patterns of components are evaluated on files: below the joins of edges, not on their rows."""
    plan = carriers.edges(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.split("Join")[0]


def test_component_graph_reads_its_edges_once(spark):
    """What asks several things of a component graph doesn't read the edges anew for each."""
    g = metrics.component_graph(carriers.edges(spark, SF))
    assert "lineitem" not in " ".join(context.observed(g).inputFiles())


def test_items_of_a_commit_meet_without_a_join(spark):
    """Pairs come from a commit's own row, dealt over all partitions; null items and commits make none, repeats count once."""
    changed = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "a"), ("1", None), ("2", "b"), ("2", "a"), ("2", "c"), (None, "a"), (None, "b")], "sha string, item string")
    counts = history.pair_counts(changed)
    assert "Join" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in counts.collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
    assert {tuple(r) for r in history.item_counts(changed).collect()} == {("a", 3), ("b", 3), ("c", 1)}


def exchanges(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "RepartitionByExpression" in line]


@pytest.mark.parametrize("name", ["fp_edge", "propagation_cost"])
def test_rows_are_dealt_before_they_are_held(spark, name):
    """Edges are dealt over all partitions by a key, so that tasks that sort or hash them hold a share."""
    made = carriers.edges(spark, SF) if name == "propagation_cost" else QUERIES[name](spark, SF)
    assert exchanges(made)


def test_heights_beside_cycles(spark):
    """A node that reaches no cycle leaves with its targets; a cycle counts as one node, a pair that comes twice as one."""
    told = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("x", "y"), ("z", "z"), ("a", None)], "a string, b string")
    assert {tuple(r) for r in graph.heights(told).collect()} == {("a", 3), ("b", 2), ("c", 2), ("d", 1), ("e", 0), ("x", 1), ("y", 0), ("z", 0)}


def test_rounds_move_numbers(spark):
    """Names of nodes are read at both ends only."""
    names, edges = graph._numbered(spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "b")], "a string, b string"))
    assert [t for _, t in edges.dtypes] == ["bigint", "bigint"] and edges.count() == 2 and names.count() == 2


def test_partitions_grow_with_the_files(spark, monkeypatch, tmp_path):
    """A task's share of dealt rows doesn't grow with the table, whatever the number of shuffle partitions; rows without files take that number."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = str(tmp_path / "a table")
    spark.range(5000).repartition(3).write.parquet(kept)
    size = sum(f.stat().st_size for f in (tmp_path / "a table").glob("*.parquet"))
    rows = spark.read.parquet(kept)
    assert bounded.spread(rows, "id").rdd.getNumPartitions() == least and bounded.dealt(rows, "id") is rows
    monkeypatch.setattr(bounded, "SHARE", size // 40)
    assert 40 <= bounded.shares(rows) <= 41 == bounded.dealt(rows, "id").rdd.getNumPartitions() == bounded.spread(rows, "id").rdd.getNumPartitions()
    assert bounded.shares(spark.range(10)) == least
    with bounded.parted(spark, 9):
        assert rows.groupBy("id").count().count() == 5000 and spark.conf.get("spark.sql.shuffle.partitions") == "9"
    assert spark.conf.get("spark.sql.shuffle.partitions") == str(least)


@pytest.mark.parametrize("name", ["cochange_files", "cochange_components"])
def test_changes_are_read_once(spark, name, tmp_path):
    """Items and pairs of commits are counted together and settled, so what asks for pairs twice, as clusters do, reads counts."""
    assert "lineitem" not in " ".join(QUERIES[name](spark, SF).inputFiles())


def test_cochange_of_null_commits_and_items(spark):
    """A null commit counts its items but opens no pairs; null items are none."""
    changed = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", None), ("2", "a"), ("2", "b"), (None, "a"), (None, "b"), ("3", "c")], "sha string, item string")
    assert [tuple(r) for r in history.cochange(changed, 1, 0.0).collect()] == [("a", "b", 2, 0.667)]
    usable = history.usable(changed.withColumnRenamed("item", "path"), 2)
    assert {tuple(r) for r in usable.collect()} == {("2", "a"), ("2", "b"), ("3", "c")} and usable.columns == ["sha", "path"]


def test_payloads_are_parsed_once(spark):
    """Each field that a payload is asked for doesn't parse it anew, and good ones and others come from one pass."""
    plan = QUERIES["hook_intake"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") + plan.count("parse_json") == 1 and "union" not in plan


def test_edges_are_made_once_for_two_questions(spark, monkeypatch):
    """Both passes over the edges of a component graph read one exchange of the rows before their last join, whichever columns they need; large files deal all steps."""
    monkeypatch.setattr(bounded, "SHARE", 1 << 12)
    e = carriers.edges(spark, SF).withColumn("target", F.col("to_"))
    n = bounded.shares(carriers.read(spark, SF, "lineitem"))
    counted, first = e.groupBy("src.component", "dst.component", "kind").count(), e.groupBy("src.component", "dst.component").agg(F.min(F.struct("from_", "line", "target")).alias("m"))
    cut = [[x.strip(" :+-") for x in exchanges(q)] for q in (counted, first)]
    numbers = lambda lines: [re.sub(r"#\d+L?", "", x) for x in lines]
    assert numbers(cut[0]) == numbers(cut[1]) and len(cut[0]) == 4 and all(x.endswith(f", {n}") for x in cut[0]) and n > 4
    plans = [re.sub(r"#\d+L?|_\d+", "", q._jdf.queryExecution().optimizedPlan().toString()).split("RepartitionByExpression", 1)[1] for q in (counted, first)]
    below = [re.sub(r"(?m)^[ :+-]+", "", x).split("RepartitionByExpression [pk]")[0] for x in plans]
    assert below[0] == below[1]
