import base64

from pyspark.sql import functions as F

from bytelore.functions import references as rf


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_paths(spark):
    cases = {
        r"C:\Program Files\App\a.exe": rf.UNQUOTED | rf.ABSOLUTE, r'"C:\Program Files\App\a.exe"': rf.ABSOLUTE, r"\\srv\share\a.bat": rf.UNC, r"%TEMP%\a.exe": rf.ENVIRONMENT, r"bin\a.exe": rf.RELATIVE,
        r"C:\Users\Public\x.exe": rf.ABSOLUTE | rf.INSECURE, "a.exe": 0, "/tmp/x.sh": rf.ABSOLUTE | rf.INSECURE,
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", rf.path_issues(F.col("t")).alias("x")).collect()
    assert {x["t"]: x["x"] for x in got} == cases and one(spark, None, rf.path_issues) == 0


def test_tasks_policies_and_shortcuts(spark):
    task = "<Task><Principal><RunLevel>HighestAvailable</RunLevel></Principal><Exec><Command>\"C:\\a b\\x.exe\"</Command><Arguments>-f &quot;y&quot;</Arguments></Exec></Task>"
    refs = one(spark, task, rf.task_references)
    assert [(x["kind"], x["value"], x["source_tag"]) for x in refs] == [("Command", '"C:\\a b\\x.exe"', "task:exec"), ("Arguments", '-f "y"', "task:args")] and one(spark, task, rf.runs_highest)
    ini = "[Startup]\r\n0CmdLine=\\\\srv\\s\\a.cmd\r\n0Parameters=/q\r\n"
    assert [(x["value"], x["issues"]) for x in one(spark, ini, rf.policy_references)] == [("\\\\srv\\s\\a.cmd", rf.UNC), ("/q", rf.ABSOLUTE)]
    assert [x["value"] for x in one(spark, "[InternetShortcut]\nURL=https://a.example/\n", rf.shortcut_references)] == ["https://a.example/"]
    assert len(one(spark, ini + ini, lambda t: rf.merged(rf.policy_references(t), rf.policy_references(t)))) == 2


def test_embedded_data_and_tokens(spark):
    text = "x data:text/javascript;base64,YWxlcnQ= y data:image/png;base64,iVBORw0K data:text/javascript;base64,YWJjZA=="
    assert one(spark, text, rf.embedded_data) == "js:2,png:1" and one(spark, "data: none", rf.embedded_data) == ""
    b = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    good = f"{b('{\"alg\":\"HS256\"}')}.{b('{\"sub\":\"1234\"}')}.abcdef123"
    assert one(spark, f"a {good} b {b('not json at all')}.{b('nor is this')}.abcdefgh c", rf.web_tokens) == 1 and one(spark, "", rf.web_tokens) == 0


def test_powershell(spark):
    assert one(spark, "[CmdletBinding()]\nparam($x)\nGet-Item x", rf.powershell_class) == "Strong" and one(spark, "echo $env:PATH", rf.powershell_class) == "Weak" and one(spark, "plain words", rf.powershell_class) == "None"
    assert one(spark, "Get-Item x; get-item y\nSet-Location z", rf.cmdlets) == ["get-item", "set-location"]
