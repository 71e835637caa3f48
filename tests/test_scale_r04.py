"""What the fourth review found about larger tables: USR files that no row, no task and no Python object holds."""

import random

import pytest
from pyspark.sql import functions as F

from fathomline.plans import documents
from fathomline.plans.queries import QUERIES
from fathomline.sinks.usr import encode
from fathomline.sources import layout, usr

SF = "/root/testdata/sf0.001"


def test_usr_routes_come_in_pieces(spark):
    """neither a file nor the legs of a route are gathered to a row; no piece is larger than a record, and the pieces make up whole files."""
    plan = QUERIES["usr_routes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "explode" not in plan
    pieces = documents._usr_pieces(spark, SF).collect()
    assert max(len(r.content) for r in pieces) < 300
    for file in range(7):
        whole = usr.decode(b"".join(r.content for r in sorted((r for r in pieces if r.source_file == str(file)), key=lambda r: r.place)))
        ids = [int(w["waypt_description"].split()[1]) for w in whole["waypoints"]]
        assert ids == [k for k in range(min(ids), max(ids) + 1) if k % 7 == file]
        assert [r["route_name"] for r in whole["routes"]] == [f"R{file}"]
        assert whole["routes"][0]["leg_uuids"] == [w["uuid"] for w, k in zip(whole["waypoints"], ids) if k % 5 == 0] + ["00000000-0000-0000-0000-000000000001"]


def _files() -> dict[str, bytes | None]:
    """Whole and broken files: of none to many waypoints and routes, cut, with bytes changed."""
    rng = random.Random(4)
    points = [{"waypt_name": f"é{k}", "uuid": f"00000000-0000-0000-0000-{k:012d}", "latitude": 0.001 * k} for k in range(40)]
    routes = [{"route_name": f"r{n}", "leg_uuids": [p["uuid"] for p in points[n : n + n * 3]]} for n in range(5)]
    whole = encode({"file_title": "t", "waypoints": points, "routes": routes})
    out = {"whole": whole, "none": None, "empty": b"", "old": encode({"format": 4}), "bare": encode({}), "more": whole + b"ab"}
    for k in range(60):
        data = bytearray(whole[: rng.randrange(len(whole))] if k % 2 else whole)
        for _ in range(k % 3):
            data[rng.randrange(len(data))] = rng.randrange(256)
        out[f"broken{k}"] = bytes(data)
    return out


def test_pieces_are_read_as_whole_files(spark):
    """wherever files are cut to pieces, in whatever order these come, waypoints and legs are those of the whole decoding."""
    rng, pieces, files = random.Random(1), [], _files()
    for name, data in files.items():
        at = 0
        while data and at < len(data):
            size = rng.choice((0, 1, 3, 50, 1000))
            pieces.append((name, len(pieces), data[at : at + size]))
            at += size
        pieces.append((name, len(pieces), None if data is None else b""))
    rng.shuffle(pieces)
    cut = spark.createDataFrame(pieces, "source_file string, place int, content binary").repartition(5)
    read = usr.decode_files(spark.createDataFrame(list(files.items()), "source_file string, content binary"))
    rows = lambda df: sorted(map(str, df.collect()))
    legs = ("source_file", "route", "seq", "uuid", "name", "lat", "lon")
    assert rows(usr.waypoints_of_pieces(cut)) == rows(usr.usr_waypoints(read))
    assert rows(usr.routes_of_pieces(cut).select(*legs)) == rows(usr.usr_routes(read).select(*legs))
    assert rows(usr.routes_of_files(spark.createDataFrame(list(files.items()), "source_file string, content binary")).select(*legs)) == rows(usr.usr_routes(read).select(*legs))


def test_usr_waypoints_come_in_pieces(spark):
    """no row of the plan holds a file's waypoints, and its tasks of encoding are as many as the rows ask for."""
    query = QUERIES["usr_waypoints"](spark, SF)
    assert "collect_list" not in query._jdf.queryExecution().optimizedPlan().toString()
    assert query.groupBy("doc").agg((F.max("seq") + 1 - F.count("seq")).alias("gap")).filter("gap != 0").isEmpty()


def test_a_reader_lets_go_what_was_read():
    """a reader of pieces never holds more than a few of them, whatever the file has."""
    found = layout.Layout((layout.Field("n", "i"), layout.Repeat("a", (layout.Field("_k", "h"), layout.Field("x", "{_k}s"), layout.Field("y", "q")), "n")))
    record = b"\3\0abc" + bytes(8)
    pieces, held = ((100_000).to_bytes(4, "little"), *[record] * 100_000), []
    reader = layout.Reader(pieces)
    for _, k, row in reader.records(found.steps, {}, ["a"]):
        held.append(len(reader.data))
    assert len(held) == 100_000 and max(held) < 2 * layout.AHEAD and row["x"] == b"abc"


@pytest.mark.parametrize("name", ["waypoints", "routes", "routes.leg_uuids"])
def test_lists_in_records_of_lists(name):
    """a list in another one's records, each row with the records around it as far as they stand before it; one that breaks off ends what is given."""
    for data in filter(None, _files().values()):
        whole, _ = usr.USR.decode(data)
        got = list(usr.USR.records((data[k : k + 7] for k in range(0, len(data), 7)), name))
        if "." not in name:
            assert [(k, row) for _, k, row in got] == list(enumerate(whole.get(name, [])))
        else:
            want = [(n, r["route_name"], k, x) for n, r in enumerate(whole.get("routes", [])) for k, x in enumerate(r.get("leg_uuids", []))]
            assert [(around[0][0], around[0][1]["route_name"], k, row["leg_uuids"]) for around, k, row in got] == want
