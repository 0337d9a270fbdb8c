"""Web tables whose orders have keys beyond those that an INTEGER offset can hold."""

import datetime

import pytest

from relkit.plans.registry import queries

SHIFT = 54_054_000  # a multiple of every divisor that the fixture rules use


def _write(spark, folder, base):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")

    day = datetime.datetime(1995, 1, 2)
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    put("orders", [(base + k, k % 3, "FO"[k % 2], 1.0, day, priorities[k % 3]) for k in range(10)],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    put("lineitem", [(base + k, 10 * k + n, 1, n, float(n + 1), 2.5, 0.0, 0.0, "NRA"[(k + n) % 3], "OF"[n % 2], day)
                     for k in range(10) if k != 5 for n in range(k % 3 + 1)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    put("customer", [(k, f"Customer {k}", 1, 0.0, "BUILDING") for k in range(3)],
        "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    put("pages", [(k, f"http://p/{k}", f"<html><title>red page {k}</title></html>") for k in range(5)],
        "page_id long, url string, html string")
    put("benchmark", [(k, f"red building {k}") for k in range(5)], "item_id long, text string")
    return str(folder)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return [_write(spark, tmp_path_factory.mktemp("keys"), base) for base in (0, SHIFT)]


def _plain(value, base):
    if isinstance(value, str) and base and value.startswith("t") and value[1:].isdigit():
        return f"t{int(value[1:]) - base}"
    return [_plain(x, base) for x in value] if isinstance(value, list) else value


@pytest.mark.parametrize("name", ["rank_bm25f", "corpus_stats_losses", "relation_transpose", "judge_replay",
                                  "tables_for_qrels_right", "missing_tables"])
def test_large_keys_change_no_row(spark, folders, name):
    low, high = (sorted(([_plain(v, base) for v in r] for r in queries()[name](spark, sf).collect()), key=repr)
                 for sf, base in zip(folders, (0, SHIFT)))
    assert low and low == high


def test_offsets_of_large_keys_are_whole(spark, folders):
    from relkit.plans import q_tables as qt
    got = {r.json_loc: (r.record_offset, r.record_end_offset) for r in queries()["table_meta"](spark, folders[1]).collect()}
    assert got == {f"t{SHIFT + k}": ((SHIFT + k) * 100, (SHIFT + k) * 100 + 99) for k in range(10) if k != 5}
    assert qt._records(spark, folders[1]).where("recordOffset is null").count() == 0
