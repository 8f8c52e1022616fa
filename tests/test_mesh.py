"""Goldens and invariants of the mesh operators on the derived lattice (10 x 10 x 2 at sf0.001)."""

import pytest
from pyspark.sql import functions as F

from meshloom.functions import strings as S
from meshloom.operators import cartesian as C
from meshloom.operators import topology as T
from meshloom.plans import derive as D
from meshloom.operators import graph as Gr
from meshloom.plans.cut import cut_cartesian, cut_files, cut_graph
from meshloom.sources import mesh as Src

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mesh(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_size")
    return D.hex_mesh(part, "p_partkey", F.col("p_size") % 2 == 1)


@pytest.fixture(scope="module")
def cut(mesh):
    return cut_cartesian(mesh, 2, 2, 1)


def test_summary_closed_form(cut):
    rows = {r.part_id: r for r in cut.summary().collect()}
    assert set(rows) == {0, 1, 2, 3}
    for r in rows.values():
        assert (r.n_cell, r.n_node, r.n_outer) == (50, 6 * 6 * 3, 2 * (25 + 10 + 10))
        assert r.n_outer == r.n_boundary + r.n_interface


def test_local_ids_are_dense_and_interfaces_symmetric(cut):
    for r in cut.local.groupBy("part_id").agg(F.min("local_id").alias("a"), F.max("local_id").alias("b"), F.count_distinct("local_id").alias("n")).collect():
        assert (r.a, r.b) == (1, r.n)
    met = {(r.part_id, r.nbr_id, tuple(r.face_key)) for r in cut.interfaces.collect()}
    assert met == {(b, a, k) for a, b, k in met} and len(met) == 2 * 40


def test_mixed_and_tetra_faces_conform(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey")
    for cells in (D.mixed_elements(part, "p_partkey"), D.tetra_elements(part, "p_partkey")):
        seen = T.cell_faces(cells).groupBy("face_key").count().groupBy("count").count().collect()
        assert {r[0] for r in seen} <= {1, 2}


def test_inclusive_boxes_repeat_ties_half_open_do_not(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 4.0, 4.0, 4.0)], "node_id long, x double, y double, z double")
    at = spark.createDataFrame([(1, 2.0, 1.0, 1.0), (2, 0.5, 1.0, 1.0)], "elem_id long, x double, y double, z double")
    w = C.prefixed(C.normalized(C.uniform_weights(spark, (2, 1, 1))))
    assert C.box_pick(at, C.part_boxes(nodes, w, 2, 1)).count() == 3
    assert C.assign(at, nodes, w, 2, 1).count() == 2


def test_parity_keeps_odd_multiplicities(spark):
    tet = lambda i, *n: (0, i, 10, list(n))
    cells = spark.createDataFrame([tet(1, 1, 2, 3, 4), tet(2, 1, 2, 3, 5), tet(3, 1, 2, 3, 6)], "part_id int, elem_id long, elem_type int, nodes array<long>")
    keys = {tuple(r.face_key): tuple(r.face_nodes) for r in T.outer_faces(cells).collect()}
    assert len(keys) == 10 and keys[(1, 2, 3)] == (1, 3, 2)


def test_mesh_round_trip_weights_residuals_mixed(spark, mesh, tmp_path):
    Src.write_mesh(mesh, str(tmp_path / "m"))
    back = Src.read_mesh(spark, str(tmp_path / "m"))
    assert back.nodes.count() == mesh.nodes.count() and back.elements.count() == mesh.elements.count()
    (tmp_path / "w").write_text("1 1\n\n2\n 1 3 \n")
    assert len(Src.read_weights(spark, str(tmp_path / "w")).collect()) == 5
    (tmp_path / "bad").write_text("1 1\n2\n")
    with pytest.raises(Src.MeshError):
        Src.read_weights(spark, str(tmp_path / "bad"))
    lines = spark.createDataFrame(list(enumerate(["# Residual", "# Step A B", "1", "inf", "2.5", "2", "1.0", "0.5", "3"])), "line_no long, value string")
    assert [(r.step, r.metric, r.value) for r in Src.parse_residuals(lines, 3).orderBy("step", "metric").collect()] == [(1, 0, float("inf")), (1, 1, 2.5), (2, 0, 1.0), (2, 1, 0.5)]
    stream = spark.createDataFrame([(1, [5, 1, 2, 3, 10, 4, 5, 6, 7])], "s int, d array<long>")
    assert [(r.elem_type, r.nodes) for r in Src.mixed_decode(stream, "s", "d").orderBy("pos").collect()] == [(5, [1, 2, 3]), (10, [4, 5, 6, 7])]


def test_strings(spark):
    r = spark.range(1).select(S.split(F.lit("a,,b,"), ",").alias("s"), S.trim(F.lit("\t x \n")).alias("t"), S.matches(F.lit("Wall_1"), "^wall").alias("m")).first()
    assert (r.s, r.t, r.m) == (["a", "b"], "x", True)


def test_options_are_checked():
    for bad in ((1,), (4, 2, 2, 2)):
        with pytest.raises(Src.MeshError):
            Src.check_options(*bad)


def test_cut_and_write_round_trip(spark, mesh, tmp_path):
    src, out = str(tmp_path / "m"), str(tmp_path / "parts")
    Src.write_mesh(mesh, src)
    cut_files(spark, src, out, 4, nx=2, ny=2, nz=1, multizone=True, fluid=("^fluid",), interior="interior")
    read = lambda t: spark.read.parquet(f"{out}/{t}")
    sections = {(r.part_id, r.write_seq): r for r in read("sections").collect()}
    for p in range(4):
        own = [r for k, r in sorted(sections.items()) if k[0] == p]
        # Fluid first, then solid, boundary, interior, interfaces; contiguous ids from 1.
        kinds = [next(i for i, x in enumerate(("FLUID", "SOLID", "INLET|OUTLET|WALL", "INTERIOR", "Interface")) if any(r.name.startswith(y) for y in x.split("|"))) for r in own]
        assert kinds == sorted(kinds) and kinds[0] == 0 and kinds[-1] == 4
        assert [r.start for r in own] == [1, *[r.end + 1 for r in own[:-1]]]
    # Local connectivity points at the same global nodes as the mesh.
    nodes = {(r.part_id, r.local_id): r.node_id for r in read("nodes").collect()}
    body = [tuple(nodes[r.part_id, n] for n in r.nodes) for r in read("elements").where("elem_type = 17").collect()]
    assert sorted(body) == sorted(tuple(r.nodes) for r in mesh.elements.where("elem_type = 17").collect())
    for r in read("elements").groupBy("part_id", "write_seq").agg(F.min("elem_id").alias("a"), F.max("elem_id").alias("b"), F.count("*").alias("n")).collect():
        s = sections[r.part_id, r.write_seq]
        assert (r.a, r.b, r.n) == (s.start, s.end, s.end - s.start + 1)
    for bad in ({"np": 1}, {"np": 5, "nx": 2, "ny": 2, "nz": 1}, {"np": 2, "method": "graph", "fluid": ("nothing",)}, {"np": 2, "method": "other"}, {"np": 2, "method": "graph", "multizone": True}):
        with pytest.raises(Src.MeshError):
            cut_files(spark, src, str(tmp_path / "bad"), **bad)


def test_refinement_lowers_the_edge_cut_and_keeps_balance(mesh, spark):
    edges = Gr.face_graph(mesh.elements.where("elem_type = 17"))
    cut = {k: cut_graph(mesh, 6, rounds=k).cells.select("elem_id", "part_id") for k in (0, 4)}
    cost = {k: Gr.edge_cut(edges, v).first().edge_cut for k, v in cut.items()}
    assert cost[4] < cost[0] and Gr.balance(cut[4]).first().imbalance <= 1.05
    assert cut[4].count() == cut[4].distinct().count() == 200


def test_curve_takes_any_coordinates(spark):
    far = spark.createDataFrame([(i, -1e6 + 1e5 * (i % 8), 3e7 + i // 8, -5.0) for i in range(64)], "elem_id long, x double, y double, z double")
    codes = [r.code for r in Gr.curve_codes(far).collect()]
    assert len(set(codes)) == 64 and min(codes) >= 0
    sizes = [r["count"] for r in Gr.sfc_partition(far, 5).groupBy("part_id").count().collect()]
    assert sorted(sizes) == [12, 13, 13, 13, 13]


def test_append_goes_on_after_the_largest_id(spark, mesh, tmp_path):
    path = str(tmp_path / "m")
    Src.write_mesh(mesh, path)
    top = mesh.sections.agg(F.max("end")).first()[0]
    one = Src.section(mesh, 4)
    extra = D.Mesh(mesh.nodes.limit(0), one.withColumn("section_id", F.lit(7)), mesh.sections.where("section_id = 4").withColumn("section_id", F.lit(7)), mesh.layers)
    Src.write_mesh(extra, path, "append")
    got = Src.read_mesh(spark, path).elements.where("section_id = 7").agg(F.min("elem_id"), F.max("elem_id")).first()
    assert tuple(got) == (top + 1, top + 100)
    assert [r.elem_id for r in Src.renumbered(Src.union_sections(mesh, (3, 4), 1, 10**6), 11).orderBy("elem_id").collect()] == list(range(11, 211))


def test_residual_stream_and_memory_log(spark, tmp_path):
    from meshloom.streaming import monitor

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a").write_text("# Residual\n# Step A B\n1\ninf\n2.5\n2\n1.0\n0.5\n3\n")
    q = monitor.watch(spark, str(tmp_path / "logs")).writeStream.format("memory").queryName("residuals").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    got = {tuple(r) for r in spark.table("residuals").collect()}
    assert got == {(1, "A", float("inf")), (1, "B", 2.5), (2, "A", 1.0), (2, "B", 0.5)}
    import os

    assert monitor.sample_memory(os.getpid(), str(tmp_path / "mem"), every=0.01, most=3) == 3
    rows = monitor.memory_log(spark.read.text(str(tmp_path / "mem"))).collect()
    assert sorted(r.step for r in rows) == [1, 2, 3] and all(r.gb > 0.01 for r in rows)


def test_mixed_streams_that_are_damaged(spark):
    ok = spark.createDataFrame([(1, [5, 1, 2, 3]), (2, []), (3, None)], "s int, d array<long>")
    assert [tuple(r) for r in Src.mixed_decode(ok, "s", "d").collect()] == [(1, 0, 5, [1, 2, 3])]
    for bad in ([99, 1], [5, 1, 2]):
        with pytest.raises(Exception, match="unknown element type|ends inside"):
            Src.mixed_decode(spark.createDataFrame([(1, bad)], "s int, d array<long>"), "s", "d").collect()


def test_damaged_meshes_and_precision(spark, mesh, tmp_path):
    with pytest.raises(Src.MeshError):
        Src.read_mesh(spark, str(tmp_path / "nothing"))
    path = str(tmp_path / "m")
    single = D.Mesh(mesh.nodes.select("node_id", *[F.col(a).cast("float") for a in "xyz"]), mesh.elements, mesh.sections, mesh.layers)
    Src.write_mesh(single, path)
    assert Src.precision(Src.read_mesh(spark, path)) == 32 and Src.precision(mesh) == 64
    mesh.nodes.drop("z").write.mode("overwrite").parquet(f"{path}/nodes")
    with pytest.raises(Src.MeshError, match="no column z"):
        Src.read_mesh(spark, path)
    Src.write_mesh(D.Mesh(mesh.nodes.where("node_id != 3"), mesh.elements, mesh.sections, 0), str(tmp_path / "gap"))
    with pytest.raises(Src.MeshError):
        Src.read_mesh(spark, str(tmp_path / "gap"))


def test_unknown_types_have_their_centre_at_the_origin(spark):
    from meshloom.functions import geometry as G

    odd = spark.createDataFrame([(1, 99, [(0, 1.0, 2.0, 3.0)])], "elem_id long, elem_type int, points array<struct<pos:int,x:double,y:double,z:double>>")
    assert tuple(G.add_centroid(odd).select("x", "y", "z").first()) == (0.0, 0.0, 0.0)


def test_interface_centres_are_dumped(spark, cut, tmp_path):
    rows = cut.interfaces.select("part_id", "nbr_id", "face_key", F.lit(7).alias("elem_type"), F.col("face_nodes").alias("nodes"))
    at = T.centers(rows, cut.mesh.nodes, ("part_id", "nbr_id", "face_key"))
    Src.write_center_dumps(at, str(tmp_path / "d"))
    got = spark.read.text(str(tmp_path / "d")).groupBy("name").count().collect()
    assert {r.name for r in got} == {f"Interface_{a}_{b}" for a, b in ((0, 1), (1, 0), (0, 2), (2, 0), (1, 3), (3, 1), (2, 3), (3, 2))} and {r["count"] for r in got} == {10}


def test_dual_graph_broadcasts_no_cells(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey")
    graph = Gr.dual_graph(D.mixed_elements(part, "p_partkey"))
    assert graph.where("a >= b OR n_shared < 3").count() == 0 and graph.count() == graph.select("a", "b").distinct().count() > 0
    # The plan's estimate of exploded rows is far below the default threshold, whatever the table's length.
    plan = graph._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


CENTRES = ("cell_centers", "centroid_hexa", "centroid_penta", "centroid_pyra")


@pytest.mark.parametrize("name", CENTRES)
def test_apexes_may_have_ids_of_lattice_nodes(spark, tmp_path, name):
    import duckdb

    from meshloom.plans import queries

    # Apexes from 100001 on meet the nodes of layer 826.
    keys = spark.range(300).union(spark.range(82600, 82700))
    keys.selectExpr("id AS p_partkey", "CAST(id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    whole = "elem_id <= 1200 OR elem_id > 495600"  # layers with the nodes above them
    centres = queries.QUERIES[name](spark, str(tmp_path))
    assert "Broadcast" not in centres._jdf.queryExecution().executedPlan().toString()
    got = centres.where(whole).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet/*.parquet'")
    want = db.execute(f"SELECT * FROM ({queries.ORACLES[name]}) WHERE {whole}").fetchall()
    assert want and sorted(map(tuple, got)) == sorted(want)


GAPPED = ("centroid_hexa", "centroid_penta", "centroid_pyra")


@pytest.mark.parametrize("name", GAPPED)
def test_keys_may_have_gaps_and_come_twice(spark, tmp_path, name):
    import duckdb

    from meshloom.plans import queries

    # Layers 3 to 9 and half of the last one are missing; forty cells are listed twice.
    keys = spark.range(300).union(spark.range(1000, 1150)).union(spark.range(40))
    keys.selectExpr("id AS p_partkey", "CAST(id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet/*.parquet'")
    want = db.execute(queries.ORACLES[name]).fetchall()
    assert want and set(map(tuple, got)) == set(want) and len(got) == len(want)


KEYLESS = ("centroid_penta", "centroid_pyra")


@pytest.mark.parametrize("name", KEYLESS)
def test_tables_without_keys_have_no_centres(spark, tmp_path, name):
    import duckdb

    from meshloom.plans import queries

    for case, rows in (("none", []), ("null", [(None, 1), (None, 2)])):
        at = f"{tmp_path}/{case}"
        spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{at}/part.parquet")
        db = duckdb.connect()
        db.execute(f"CREATE VIEW part AS FROM '{at}/part.parquet/*.parquet'")
        got = queries.QUERIES[name](spark, at).collect()
        assert got == db.execute(queries.ORACLES[name]).fetchall() == []
        assert queries.mesh(spark, at).nodes.count() == 0


def test_formatted_names_of_long_keys_equal_the_sql(spark, tmp_path):
    import duckdb

    from meshloom.plans import queries

    rows = [(0, 1), (-7, 2), (999999, 3), (1000000, 4), (1199999, 5), (12, None), (None, 6)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet/*.parquet'")
    assert set(map(tuple, queries.QUERIES["str_format"](spark, str(tmp_path)).collect())) == set(db.execute(queries.ORACLES["str_format"]).fetchall())
