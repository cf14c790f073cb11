from kelpline.operators import profile
from kelpline.plans import report


def test_transitive_tests_are_in_the_order_of_words(spark):
    names = ["Zebra.test.ts", "apple.test.ts", "Éclair.test.ts", "zoo.test.ts", "Apple.test.ts", "egg.test.ts", "b_x.test.ts", "b-x.test.ts"]
    found = spark.createDataFrame([("r", n, kind, "v") for kind in ("transitive", "direct") for n in names], "root string, test string, kind string, via string")
    row = profile.tests_by_file(found).first()
    assert [t.test for t in row.transitive_tests] == ["apple.test.ts", "Apple.test.ts", "b_x.test.ts", "b-x.test.ts", "Éclair.test.ts", "egg.test.ts", "Zebra.test.ts", "zoo.test.ts"]
    assert list(row.direct_tests) == sorted(names) and row.n_tests == 16
    assert row.transitive_tests[0].via == "v"


def test_bare_components_are_in_the_order_of_words(spark):
    names = ["beta", "Alpha", "alpha", "Émile", "Zeta", "eel"]
    cols = "ord long, id string, type string, lines int, complexity double, n_imports int, exports array<string>, methods array<string>, route string, client boolean"
    nodes = spark.createDataFrame([(i, f"ui/{n}.tsx", "component", 7, 0.1, 0, [], [], "", False) for i, n in enumerate(names)], cols)
    modules = spark.createDataFrame([("ui", 6, 42, 0)], "module string, files long, lines long, entries long")
    none = spark.createDataFrame([], "node string, importers long")
    coverage = spark.createDataFrame([(0, 0, 6)], "test_edges long, tested long, testable long")
    got = report.text(report.plain_text("p", "f", nodes, modules, none, coverage, bare=True)).split("\n")
    assert [x[2:].split(".")[0] for x in got if x.endswith("(7 lines)")] == ["alpha", "Alpha", "beta", "eel", "Émile", "Zeta"]
