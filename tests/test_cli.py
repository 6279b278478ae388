"""The verbs on a small log."""

from tidewater import cli


def test_verbs(spark, tmp_path):
    d = f"file://{tmp_path}/log"
    do = lambda *args: cli.run(spark, [d, *args])
    assert do("count") == ["0"] and do("get", "a") == ["not found"]
    do("batchput", "a", "1", "b", "2", "c", "3", "d", "4")
    do("delete", "a")
    do("put", "b", "22")
    do("deleterange", "c", "e")
    do("put", "d", "5")
    assert do("get", "a") == ["not found"] and do("get", "b") == ["22"] and do("get", "c") == ["not found"]
    assert do("scan") == ["b\t22", "d\t5"] and do("scan", "--reverse", "--limit", "1") == ["d\t5"] and do("scan", "--low", "c") == ["d\t5"]
    assert do("multiget", "a", "d") == ["a\t", "d\t5"] and do("count") == ["2"]
    assert do("approxsize", "c") == ["0\t1\t3", "1\t1\t2"]
    assert do("history", "b") == ["1\tPUT\t2", "5\tPUT\t22"] and do("checkconsistency") == ["OK"]
    do("singledelete", "b")
    assert do("get", "b") == ["not found"]
    do("singledelete", "zz")
    assert do("checkconsistency") == ["nothing to cancel\t9"]
    do("dump", f"{tmp_path}/dump")
    do("compact", f"{tmp_path}/compacted")
    other = f"file://{tmp_path}/other"
    cli.run(spark, [other, "load", f"{tmp_path}/dump"])
    assert cli.run(spark, [other, "scan"]) == ["d\t5"] == cli.run(spark, [f"{tmp_path}/compacted", "scan"])
