"""Writing a run's tables, and its report."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from functools import reduce
from typing import Any

from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import open_fs
from .pipeline import AnalysisResult

TABLES = ("raw", "comments", "quality", "clusters", "representatives", "painpoints", "positives", "cards", "word_cloud", "threads", "news", "media")
# The report's headings, lines and closing notes, and a CSV file's first bytes.
SPORTS = {"basketball": "篮球", "football": "足球"}
UNKNOWN, NONE, YES, NO = "未指定", "无", "是", "否"
SECTIONS = (("关键观点", "key_viewpoints"), ("正向评价", "positive_insights"), ("负向评价", "negative_insights"), ("争议焦点", "controversies"), ("新闻与评论对照", "context_alignment"), ("事实与观点缺口", "fact_opinion_gaps"), ("解读风险", "risks"))
LINES = {
    "match": ("- 运动：{sport}", "- 虎扑板块：{board}", "- 比赛：{match}", "- 阶段：{stage}", "- 时间：{date}", "- 评论来源：虎扑公开帖子 {n_threads} 个", "- 状态：{status}"),
    "quality": ("- 原始评论：{raw_count}", "- 清洗后评论：{clean_count}", "- 去重后评论：{dedup_count}", "- 重复率：{duplicate_ratio:.1%}", "- 噪声率：{noise_ratio:.1%}", "- 样本可信度：{sample_confidence_level}"),
    "warning": ("- 警告：{warning}",),
    "thread": ("- [{title}]({url})：采样评论 {n_comments} 条",),
    "excerpt": ("  - 主帖摘要：{excerpt:.240}",),
    "image": ("- 来源：[{title}]({source_url})", "  - 来源级别：{authority_level}", "  - 筛选理由：{selection_reasons}", "  - 图片：{url}", "  - 视觉摘要：{summary}", "  - 数据点：{data_points}", "  - OCR：{ocr_text}", "  - 相关性：{relevance}；信息量：{information_value}；置信度：{confidence}；模型：{model}"),
    "audit": ("- 图像筛选审计：共审查 {reviewed} 张，排除 {excluded} 张。",),
    "excluded": ("  - 已排除《{title}》：{exclusion_reason}",),
    "cluster": ("### {cluster_name}", "", "- 评论数：{cluster_size}", "- 占比：{cluster_ratio:.1%}", "- 方法：{method}", "- 噪声类：{noise}", "- 关键词：{keywords}"),
    "representative": ("- 代表评论：{text}",),
    "card": ("### {title}", "", "- 类型：{card_type}", "- 证据数：{evidence_count} / 样本量：{sample_size}", "- 影响占比：{affected_ratio:.1%}", "- 可信度：{confidence}（{confidence_reason}）", "- 预期影响：{expected_impact}"),
    "action": ("- 建议：{text}",),
    "evidence": ("- 证据评论：{text}",),
}
NO_ITEMS, NO_CARDS, NO_THREADS, NO_IMAGES = "- 暂无。", "- 没有达到至少两条评论证据门槛的策略卡。", "- 暂无帖子上下文。", "- 本次没有候选主帖、新闻或官网信息图。"
UNTITLED, FAILED_EVIDENCE = "未命名来源", "未通过视觉证据门槛"
CLOSING = ("本报告只处理用户指定的虎扑公开帖子和公开新闻页面，不绕过登录、验证码、付费墙或平台权限。", "新闻内容用于补充事实背景；网友评论属于抽样观点，不能替代比赛数据、官方判罚说明或可靠新闻事实。")
BOM = "\ufeff"
# End of fixed values.
COLUMNS = ("id", "platform", "topic", "content", "author_hash", "like_count", "reply_count", "publish_time", "source_url")


def persist(result: AnalysisResult, folder: str, task_id: str) -> None:
    """Each table under ``folder``, one partition per task; a task that runs again replaces its own partitions and no others."""
    for name in TABLES:
        frame: DataFrame = getattr(result, name)
        out = frame.drop("task_id").withColumn("task_id", F.lit(task_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(f"{folder}/{name}")


def _place(task_id: str) -> str:
    """A folder's name for a task, of letters that every file system and address takes."""
    return re.sub(r"[^A-Za-z0-9-]+", "_", task_id)[:40] + "-" + hashlib.sha1(task_id.encode()).hexdigest()[:12]


def commit(result: AnalysisResult, folder: str, task_id: str) -> str:
    """All tables of a run as one: they are written to a place of their own, then the task's pointer is put in the place of the former one, which is one step.

    A run that fails before leaves the former run whole; :func:`committed` never sees parts of a run. Gives back the version; versions that no pointer names may be removed by
    :func:`without_others` once nothing reads them.
    """
    version = uuid.uuid4().hex
    for name in TABLES:
        frame: DataFrame = getattr(result, name)
        frame.drop("task_id").write.parquet(f"{folder}/versions/{_place(task_id)}/{version}/{name}")
    files, path = open_fs(f"{folder}/current")
    files.create_dir(path, recursive=True)
    draft = f"{path}/.{version}"
    with files.open_output_stream(draft) as out:
        out.write(json.dumps({"task_id": task_id, "version": version}).encode())
    files.move(draft, f"{path}/{_place(task_id)}.json")
    return version


def versions(folder: str) -> dict[str, str]:
    """The version of every task that counts."""
    files, path = open_fs(f"{folder}/current")
    if files.get_file_info(path).type == FileType.NotFound:
        return {}
    found = (f for f in files.get_file_info(FileSelector(path)) if f.base_name.endswith(".json") and not f.base_name.startswith("."))
    told = (json.loads(files.open_input_stream(f.path).read()) for f in found)
    return {t["task_id"]: t["version"] for t in told}


def committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table over all tasks' runs that count, with ``task_id``; tasks without columns that others have get nulls."""
    parts = [spark.read.parquet(f"{folder}/versions/{_place(t)}/{v}/{name}").withColumn("task_id", F.lit(t)) for t, v in sorted(versions(folder).items())]
    if not parts:
        raise ValueError("no run has been committed")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def without_others(folder: str, task_id: str) -> int:
    """Removes a task's versions that do not count; how many."""
    files, path = open_fs(f"{folder}/versions/{_place(task_id)}")
    kept = versions(folder).get(task_id)
    gone = [f.path for f in files.get_file_info(FileSelector(path)) if f.base_name != kept]
    for g in gone:
        files.delete_dir(g)
    return len(gone)


def demo_csv(rows: DataFrame, path: str) -> None:
    """A folder of CSV files with a header."""
    rows.select(*COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def single_csv(rows: DataFrame, uri: str) -> None:
    """One CSV file that begins with a byte order mark, for spreadsheets; the driver writes it row by row, so it is meant for a task's rows."""
    files, path = open_fs(uri)
    with files.open_output_stream(path) as out:
        out.write((BOM + ",".join(COLUMNS) + "\r\n").encode())
        quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in COLUMNS]
        for row in rows.orderBy("seq").select(F.concat_ws(",", *quoted).alias("line")).toLocalIterator():
            out.write((row["line"] + "\r\n").encode())


def _filled(kind: str, **values: Any) -> list[str]:
    return [line.format_map(values) for line in LINES[kind]]


def _match(result: AnalysisResult) -> list[str]:
    c = result.config
    return _filled("match", sport=SPORTS[c.domain], board=c.board or UNKNOWN, match=c.match_name or c.versus or UNKNOWN, stage=c.match_stage or UNKNOWN, date=c.match_date or UNKNOWN, n_threads=len(c.thread_urls), status="completed")


def _quality(result: AnalysisResult) -> list[str]:
    q = result.quality.first().asDict()
    return _filled("quality", **q) + (_filled("warning", **q) if q["warning"] else [])


def _threads(result: AnalysisResult) -> list[str]:
    rows = [r.asDict() for r in result.threads.orderBy("first_seq").collect()]
    return [line for r in rows for kind in ("thread", "excerpt") if kind == "thread" or r["excerpt"] for line in _filled(kind, **r)] or [NO_THREADS]


def _images(result: AnalysisResult) -> list[str]:
    """Bounded by the distinct images of a run's threads and articles."""
    counted, left = [], []
    for r in result.media.orderBy("rank", "pos").collect():
        row = {k: NONE if v in (None, "", []) else "；".join(v) if isinstance(v, list) else v for k, v in r.asDict(recursive=True).items()}
        row["title"] = r["title"] or UNTITLED
        if r["included_in_summary"]:
            counted += _filled("image", **row)
        else:
            left += _filled("excluded", **row | {"exclusion_reason": r["exclusion_reason"] or FAILED_EVIDENCE})
    audit = _filled("audit", reviewed=len(counted) // len(LINES["image"]) + len(left), excluded=len(left)) if left else []
    return counted + audit + left or [NO_IMAGES]


def _clusters(result: AnalysisResult) -> list[str]:
    lines = []
    for c in result.clusters.orderBy(F.desc("cluster_size"), "cluster_id").limit(20).collect():
        lines += _filled("cluster", noise=YES if c["is_noise"] else NO, keywords=", ".join(c["top_keywords"]), **c.asDict())
        lines += [line for t in c["representative_comments"] for line in _filled("representative", text=t)] + [""]
    return lines


def _cards(result: AnalysisResult) -> list[str]:
    lines = []
    for c in result.cards.orderBy("card_rank").collect():
        lines += _filled("card", **c.asDict())
        lines += [line for a in c["suggested_actions"] for line in _filled("action", text=a)]
        lines += [line for e in c["evidence_comments"] for line in _filled("evidence", text=e["content"])] + [""]
    return lines or [NO_CARDS, ""]


def markdown(result: AnalysisResult, title: str = "") -> str:
    """The report in fixed order; collects one row per label, cluster, card, thread and image, never comments."""
    prose = result.insight
    parts = [
        ("比赛信息", _match(result)),
        ("数据质量", _quality(result)),
        ("虎扑帖子上下文", _threads(result)),
        ("新闻背景", [prose["news_context_summary"]]),
        ("主帖与权威来源图像证据", _images(result)),
        ("舆情摘要", [prose["summary"]]),
        *((name, [f"- {x}" for x in prose[key]] or [NO_ITEMS]) for name, key in SECTIONS),
    ]
    out = [f"# {title or result.config.name}", ""]
    for name, lines in parts:
        out += [f"## {name}", "", *lines, ""]
    out += ["## 主题聚类", "", *_clusters(result), "## 证据支撑的策略卡", "", *_cards(result), "## 合规与解释边界", "", *CLOSING]
    return "\n".join(out)
