import io
import zipfile

from scriptorium.operators import manuscript, pii
from scriptorium.sources import files

PACKET = "# 论文正文_示例（全文 v5）\n> 题目：《示例》\n> 写作状态：初稿\n\n## 一、甲\n甲[待核]。<!-- 内部 -->【来源】\n"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_packet(spark):
    d = docs(spark, PACKET, None, "")
    got = {r["doc_id"]: r for r in manuscript.packet_clean(d).collect()}
    r = got[1]
    assert r["title"] == "示例" and r["text"].startswith("# 示例\n") and "写作状态" not in r["text"] and "内部" not in r["text"]
    assert (r["comments"], r["placeholders"], r["todos"]) == (1, 1, 1) and "[待核]" in r["text"] and r["text"].endswith("】\n")
    assert "[待核]" not in manuscript.packet_clean(d, strip_todo=True).where("doc_id = 1").first()["text"]
    assert set(got) == {1, 3}


def test_blocks(spark):
    text = "\n> 题目：《题》\n# 题\n## A\n### B\n> q\n| a | b |\n|---|---|\n| c |\n---\n#### C\n甲**乙**[^1]丙\n[^1]: 注\n## 参考文献\n[1] 张\n续\n"
    got = [(r["kind"], r["text"]) for r in manuscript.blocks(docs(spark, text)).orderBy("line_no").collect()]
    assert got == [("meta", "题"), ("title", "题"), ("h1", "A"), ("h2", "B"), ("quote", "q"), ("table", "| a | b |"), ("table", "|---|---|"), ("table", "| c |"), ("p", "#### C"), ("p", "甲**乙**[^1]丙"), ("note", "注"), ("ref", "张"), ("ref_more", "续")]
    cells = [(r["col"], r["cell"]) for r in manuscript.table_cells(docs(spark, text)).orderBy("line_no", "col").collect()]
    assert cells == [(1, "a"), (2, "b"), (1, "c"), (2, "")]
    runs = [(r["kind"], r["text"]) for r in manuscript.runs(docs(spark, text)).where("line_no = 12").orderBy("run").collect()]
    assert runs == [("plain", "甲"), ("bold", "乙"), ("note", "[^1]"), ("plain", "丙")]
    out = files.as_docx(manuscript.layout(docs(spark, text))).first()["content"]
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        assert "张" in z.read("word/document.xml").decode()


def test_personal_data(spark):
    text = "联系 13812345678 或 a.b@mail5.test.org，路径 C:\\Users\\zhang\\x 与 /home/zhang/，作者：王某甲，作者：某某，user@example.com"
    got = sorted((r["description"], r["fragment"]) for r in pii.hits(docs(spark, "甲\n" + text, None, "")).collect())
    by = {}
    for k, v in got:
        by.setdefault(k, []).append(v)
    assert by["中国大陆手机号"] == ["13812345678"] == by["QQ号/长数字串"]
    assert by["邮箱地址"] == ["a.b@mail5.test.org"]
    assert by["Windows 绝对路径（含机器用户名）"] == ["C:\\Users\\zhang"] and by["盘符绝对路径"] == ["C:\\Users\\zhang\\x"]
    assert by["Unix 家目录路径"] == ["/home/zhang/"] and by["作者字段后的人名"] == ["作者：王某甲"]
    assert {r["line"] for r in pii.hits(docs(spark, "甲\n" + text)).collect()} == {2}


def test_hygiene(spark):
    d = spark.createDataFrame([("x.pdf",), ("a/x.DOCX",), ("x.md",), ("x",)], "path string")
    assert {r["path"]: r["severity"] for r in pii.file_hygiene(d).collect()} == {"x.pdf": "高", "a/x.DOCX": "中"}


def test_institutions(spark):
    d = docs(spark, "作者单位：云溪大学\n载于云溪大学学报\n南浔研究院")
    assert sorted((r["line_no"], r["fragment"]) for r in pii.institutions(d).collect())
