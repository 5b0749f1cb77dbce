import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="quarry-tests")
    yield s


@pytest.fixture
def files_df(spark):
    def make(rows):
        return spark.createDataFrame(rows, "file_path string, file_name string, source_code string")
    return make


SAMPLE_CPP = """// Graph utilities
#include <vector>
using namespace std;

int add(int a, int b) {
    return a + b;
}

vector<int> bfs_order(vector<vector<int>>& graph, int start) {
    vector<int> order;
    if (graph.empty()) { return order; }
    for (int i = 0; i < 3; i++) {
        order.push_back(add(i, start));
    }
    return order;
}

static int memo_fib(int n) {
    return n < 2 ? n : memo_fib(n - 1) + memo_fib(n - 2);
}

int main() {
    vector<vector<int>> g(3);
    while (true) { break; }
    return bfs_order(g, 0).size() + memo_fib(5);
}
"""
