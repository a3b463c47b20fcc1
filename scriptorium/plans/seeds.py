"""Marks that the given tables lack, put around every text, so that each check has something to find.

A text gets one of the lines of ``BEFORE`` in front, chosen by its id, and, if it has a reference list, the entries of
``AFTER`` behind. All rows and whole texts stay.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEFORE = [
    "值得注意的是，与此同时，进一步的研究具有里程碑意义。学界普遍认为应予肯定。",
    "学界普遍认为甲可取。学界普遍主张乙。学界普遍丙。众所周知，学界普遍丁。",
    "他说\"甲乙\"与\"丙，又说'丁'和don't，再说'戊。",
    "事实上，甲。实际上，乙。事实上，丙。换言之，丁。综上所述，不言而喻，总的来说。",
    "作者单位：示明大学\n海山研究院\n参见海山学院学报\n中国法学院",
    "甲,乙,丙.丁...戊。。。己:庚;辛?壬!癸 2023—2026。填补这一领域的空白，具有十分重大的现实意义。",
    "联系 13812345678 或 a.b@mail5.test.org，路径 C:\\Users\\zhang\\x 与 /home/zhang/，作者：王某甲，作者：某某，user@example.com，姓名: 卞和",
    "## 1 数据\n## 一、概说\n### （一）来源\n### 2.1 方法\n笔者认为本文值得注意的是甲。",
]
AFTER = "[901] 甲某. 示例之一[J]. 示例刊, 2020(1): 1-5.\n[902] 甲某.“示例之一”[J].示例刊,2020(1):1-5.\n[901] 乙某. 示例之二[M]. 2021."


def seeded(docs: DataFrame) -> DataFrame:
    """docs, with what is put around their texts; null texts stay null."""
    before = F.element_at(F.array(*map(F.lit, BEFORE)), (F.pmod(F.col("doc_id"), F.lit(len(BEFORE))) + 1).cast("int"))
    after = F.when(F.contains("text", F.lit("## 参考文献")), F.lit("\n" + AFTER)).otherwise("")
    return docs.withColumn("text", F.concat(before, F.lit("\n"), "text", after))


def sql(query: str) -> str:
    """The same for a query of DuckDB."""
    q = lambda t: "'" + t.replace("'", "''") + "'"
    table = f"SELECT * REPLACE ([{', '.join(map(q, BEFORE))}][doc_id % {len(BEFORE)} + 1] || chr(10) || text || CASE WHEN contains(text, '## 参考文献') THEN {q(chr(10) + AFTER)} ELSE '' END AS text) FROM documents"
    return f"WITH seeded AS MATERIALIZED ({table}) SELECT * FROM ({re.sub(r'\bdocuments\b', 'seeded', query)})"
