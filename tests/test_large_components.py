import pytest

from lemmaflow.operators import hierarchy
from test_hierarchy import LINKS, brute, random_links


@pytest.mark.parametrize("kernel_links", [12, 3])
def test_large_components_have_paths_counts_and_pairs(spark, rows, kernel_links):
    links = random_links(7, 25, 30) + [("a", f"d{i:02}", f"d{i + 1:02}") for i in range(20)]
    df, expected = spark.createDataFrame(links, LINKS), brute(links)
    assert rows(hierarchy.descendants(df, kernel_links)) == sorted(((p, n, x) for (p, n), (_, seen) in expected.items() for x in seen), key=repr)
    plain = lambda d: sorted((*r[:6], None if r.path is None else tuple(r.path), r.n_descendants) for r in d.collect())
    got = plain(hierarchy.hierarchy_nodes(df, kernel_links))
    assert [r[:2] + r[3:6] for r in got] == sorted(v[0] for v in expected.values())
    assert all(r[7] == len(expected[r[:2]][1]) for r in got)
    assert got == plain(hierarchy.hierarchy_nodes(df))
