import json
import random
import re

import pytest

from pagegrain.operators.jsonsearch import first_string


def brute(text, key_part, pattern):
    """A stack of objects; names that are whole numbers first."""
    try:
        root = json.loads(text) if text else None
    except ValueError:
        return None
    stack = [root]
    while stack:
        node = stack.pop()
        if not isinstance(node, (dict, list)):
            continue
        if isinstance(node, list):
            pairs = [(str(i), v) for i, v in enumerate(node)]
        else:
            numbers = [k for k in node if re.fullmatch("0|[1-9][0-9]*", k) and int(k) < 2**32 - 1]
            pairs = [(k, node[k]) for k in sorted(numbers, key=int)] + [(k, v) for k, v in node.items() if k not in set(numbers)]
        for key, value in pairs:
            for item in value if isinstance(value, list) else [value]:
                if isinstance(item, str):
                    if re.search(pattern, item) and (key_part is None or key_part in key.lower()):
                        return item
                elif isinstance(item, (dict, list)):
                    stack.append(item)
    return None


def nested(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.35:
        return rng.choice(["http://a%d" % rng.randint(0, 99), "x", "", '{"a":"http://no"}', "[1]", "é😀", 7, 1.5, None, True, "urn:%d" % rng.randint(0, 99), "null", "12"])
    if kind < 0.6:
        return [nested(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    names = ["downloadUri", "Download", "a", "b.c", "it's", 'q"uote', "10", "2", "01", "4294967295", "asset id", "", "$", "é"]
    return {k: nested(rng, depth - 1) for k in rng.sample(names, rng.randint(0, 5))}


@pytest.mark.parametrize(("key_part", "pattern"), [("download", "^https?://"), (None, "^https?://"), ("asset", "urn:"), (None, "urn:"), ("1", "."), (None, "^$")])
def test_as_a_stack_would(spark, key_part, pattern):
    rng = random.Random(f"{key_part}{pattern}")
    texts = [json.dumps(nested(rng, 6), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(250)]
    texts += [None, "", "{bad", '"http://alone"', "3", "[]", "{}", '{"a":{"a":{"a":{"a":{"a":{"a":{"a":{"download":"http://deep"}}}}}}}}']
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, json string, path string").repartition(3)
    found = first_string(df, key_part, pattern)
    assert found.columns == ["id", "path", "found"]
    assert {r["id"]: r["found"] for r in found.collect()} == {i: brute(t, key_part, pattern) for i, t in enumerate(texts)}
    assert "InArrow" not in (plan := found._jdf.queryExecution().toString()) and "Python" not in plan


def test_last_in_first_out(spark):
    job = '{"first":{"download":"http://1"},"second":{"in":{"download":"http://2"},"list":["s",{"download":"http://3"}]},"third":{"x":1}}'
    assert first_string(spark.createDataFrame([(job,)], "json string"), "download", "^http").first()["found"] == "http://3"
    ties = spark.createDataFrame([('{"b":["u1","u2"],"1":"u0"}',), ('{"b":["u1","u2"],"1":"u0"}',)], "json string")
    assert [r["found"] for r in first_string(ties, None, "^u").collect()] == ["u0", "u0"]
    assert first_string(ties.limit(0), None, "u").count() == 0
