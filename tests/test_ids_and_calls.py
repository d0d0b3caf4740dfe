"""Identifiers, text folding and call signatures."""

import pytest

from stepforge.functions import ids
from stepforge.functions.calls import canonical, signature, split_calls
from stepforge.functions.fold import plain, words


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f("v").alias("x")).orderBy("i").collect()]


def test_trajectory_key(spark):
    same = ["trj-ab12", "TRJ-AB12", ' "trj_ab12" ', "ab12", "trj-ab12.json", "runs/trj-ab12.json"]
    assert set(column(spark, ids.trajectory_key, same)) == {"trj-ab12"}
    assert column(spark, ids.trajectory_key, [None, "", "  ", "trj-ab13"]) == [None, None, None, "trj-ab13"]


def test_repo_key(spark):
    same = ["own/na-me", "Own/Na-Me", "own / na-me", "own/na-me/", "own/na-me.git", "https://git.example/own/na-me", "git@git.example:own/na-me.git", "own__na-me"]
    assert set(column(spark, ids.repo_key, same)) == {"own/na-me"}
    assert column(spark, ids.repo_key, [None, "", "own/na_me"]) == [None, None, "own/na_me"]


def test_instance_key(spark):
    same = ["own__name-py-7", "OWN__NAME-PY-7", "own/name-py#7", "own__name-py_7", "\town__name-py-7", "own__name-py-0007"]
    assert set(column(spark, ids.instance_key, same)) == {"own__name-py-7"}
    assert column(spark, ids.repo_of_instance, ["own/name-py#7", None]) == ["own/name-py", None]


@pytest.mark.parametrize(
    "a, b",
    [
        ('execute_bash {"command": "ls -la"}', 'Execute_Bash  {"command":"ls -la"}'),
        ('execute_bash {"command": "ls -la"}', "execute_bash ls -la"),
        ('execute_bash {"command": "grep \\"x\\" a/"}', "execute_bash {\"command\": \"grep 'x' a/;\"}"),
        ('execute_bash {"command": "RUN_ID=1 pytest a"}', 'execute_bash {"command": "RUN_ID=e5f0a1 pytest a"}'),
        ('execute_bash {"command": "pytest --basetemp=/tmp/pt-1234"}', 'execute_bash {"command": "pytest --basetemp=/tmp/pt-20250102T030405"}'),
        ('str_replace_editor {"command": "view", "path": "/w/a.py"}', 'str_replace_editor {"path": "/w//./a.py ", "command": "view"}'),
        ('think {"thought": "It fails."}', "think IT FAILS ..."),
        ('execute_bash ls str_replace_editor {"path": "/w/a"}', 'execute_bash {"command": "ls"} str_replace_editor {"path":"/w/a"}'),
    ],
)
def test_same_calls(a, b):
    assert canonical(a) == canonical(b) and signature(a) == signature(b)


@pytest.mark.parametrize(
    "a, b",
    [
        ('execute_bash {"command": "ls -la"}', 'execute_bash {"command": "ls -l"}'),
        ('execute_bash {"command": "grep x a/"}', 'execute_bash {"command": "grep x b/"}'),
        ('str_replace_editor {"view_range": [1, 5]}', 'str_replace_editor {"view_range": [6, 9]}'),
        ('str_replace_editor {"new_str": "a"}', 'str_replace_editor {"new_str": "a\\n    # case 5"}'),
        ('think {"thought": "one"}', 'think {"thought": "two"}'),
        ('execute_bash {"command": "LOG_TS=1 pytest a"}', 'execute_bash {"command": "pytest a"}'),
    ],
)
def test_other_calls(a, b):
    assert canonical(a) != canonical(b)


def test_odd_calls():
    assert split_calls("") == [] and canonical("") == ""
    assert split_calls("   ") == []
    assert split_calls('x {"a": ')[0][0] == "x"
    assert signature("é" * 50_000) == signature("é" * 50_000)


def test_fold():
    assert plain("a&nbsp;<b>c</b>&amp;d") == "a c &d" or plain("a&nbsp;<b>c</b>&amp;d").split() == ["a", "c", "&d"]
    assert words("The​ fix\xa0оf `a_b`, 0.25") == ["the", "fix", "of", "a_b", "025"]
    assert words('{"p": "one\\ntwo"}') == ["p", "one", "two"]
    assert words("") == []
