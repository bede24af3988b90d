"""IO1 / IO7: typed CSV reads with pandas-style missing texts, output contract."""

import os
import tempfile

from demandflow.sources import io


def test_read_observations_normalises_missing_texts(spark):
    d = tempfile.mkdtemp(prefix="df-io-")
    path = os.path.join(d, "train.csv")
    with open(path, "w") as f:
        f.write("Index,geohash,day,timestamp,RoadType,NumberofLanes,LargeVehicles,Landmarks,Temperature,Weather,demand\n")
        f.write("1,qp03wc,48,7:5,Highway,2,Allowed,No,25.5,Sunny,0.25\n")
        f.write("2,qp03wd,48,7:15,NA,,null,N/A,NaN,nan,0.5\n")
        f.write("3,qp03we,49,0:0,,3,Not Allowed,Yes,,Rainy,\n")
    df = io.read_observations(spark, path, "csv", reference_names=True)
    rows = {r["idx"]: r for r in df.collect()}
    assert rows[1]["road_type"] == "Highway" and rows[1]["number_of_lanes"] == 2.0 and rows[1]["demand"] == 0.25
    r2 = rows[2]
    assert (r2["road_type"], r2["number_of_lanes"], r2["large_vehicles"], r2["landmarks"],
            r2["temperature"], r2["weather"]) == (None, None, None, None, None, None)
    assert rows[3]["road_type"] is None and rows[3]["demand"] is None and rows[3]["timestamp"] == "0:0"
    assert df.columns[:4] == ["idx", "geohash", "day", "timestamp"] and "demand" in df.columns


def test_output_contract_flags_problems(spark):
    template = spark.createDataFrame([(i,) for i in range(5)], "idx long")
    good = spark.createDataFrame([(i, 0.1 * i) for i in range(5)], "idx long, demand double")
    bad = spark.createDataFrame([(0, 0.1), (1, None), (2, -0.5), (3, 0.2), (7, 0.3)], "idx long, demand double")
    g = io.check_output(good, template).first()
    b = io.check_output(bad, template).first()
    assert g["contract_ok"] == 1 and g["n_missing_ids"] == 0
    assert b["contract_ok"] == 0 and b["n_null"] == 1 and b["n_negative"] == 1
    assert b["n_missing_ids"] == 1 and b["n_extra_ids"] == 1


def test_json_row_round_trip(spark):
    path = io.scratch_path(spark, "w")
    io.write_json_row(spark, {"w_a": 0.25, "w_b": 0.75}, path)
    assert io.read_json_row(spark, path) == {"w_a": 0.25, "w_b": 0.75}


def test_ingest_keeps_bad_rows_and_counts(spark):
    d = tempfile.mkdtemp(prefix="df-io-")
    path = os.path.join(d, "train.csv")
    with open(path, "w") as f:
        f.write("Index,geohash,day,timestamp,RoadType,NumberofLanes,LargeVehicles,Landmarks,Temperature,Weather,demand\n")
        f.write("1,qp03wc,48,7:5,Highway,2,Allowed,No,25.5,Sunny,0.25\n")
        f.write("2,qp03wd,48,7:15,NA,,null,N/A,NaN,nan,0.5\n")
        f.write("3,qp03we,forty,0:0,,3,Not Allowed,Yes,warm,Rainy,0.1\n")
        f.write("4,qp03we,48,0:0,,3,Not Allowed,Yes,1.5,Rainy,0.1,extra\n")
        f.write("5,qp03we,48\n")
        f.write("x,qp03we,48,0:0,,3,Not Allowed,Yes, 2.5 ,Rainy,0.1\n")
    got = io.ingest_observations(spark, path, reference_names=True)
    assert sorted(r.idx for r in got.good.collect()) == [1, 2]
    bad = {tuple(r.bad_columns): r for r in got.bad.collect()}
    assert set(bad) == {("day", "temperature"), ("_fields",), ("idx",)} and got.bad.count() == 4
    assert bad[("day", "temperature")].temperature == "warm" and bad[("idx",)].idx == "x"
    c = got.counts
    assert (c["rows"], c["bad_rows"], c["malformed_day"], c["malformed_temperature"], c["malformed_idx"], c["malformed_demand"]) == (6, 4, 1, 1, 1, 0)
    assert c["missing_number_of_lanes"] == 2 and c["missing_geohash"] == 0
    r = {x.idx: x for x in got.good.collect()}
    assert r[1].demand == 0.25 and r[2].temperature is None and r[2].road_type is None
