"""Generated comments for demonstrations: fixed sentences, and everything else by arithmetic on a comment's number."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentences, subjects and times of the generated comments.
PLATFORM = "hupu"
EXCERPT = "用于离线演示的虎扑风格比赛讨论，不代表真实用户观点。"
NO_TITLE = "虎扑赛事讨论"
SENTENCES = {
    "basketball": [
        "末节那个挡拆连续打成，主队战术执行真的漂亮。",
        "最后两分钟裁判这几个哨太有争议了，比赛节奏全被切碎。",
        "核心今天关键球太硬，两个三分直接把比赛收走。",
        "客队输在篮板保护，连续让对手抢到前场板不能接受。",
        "教练暂停后的联防调整有效，第三节一下把分差追回来了。",
        "替补后卫是今晚奇兵，上来之后推进速度明显快了。",
        "主队失误太多，关键回合还在粘球，球权处理有问题。",
        "这场对攻质量很高，双方球星都打出了季后赛强度。",
        "不要只怪最后一球，第二节防守漏人已经埋下隐患。",
        "从数据看客队三分命中率不差，真正差距是二次进攻。",
        "那个挑战为什么失败，回放看着明明是先碰到球。",
        "中锋护框和换防都在线，这场防守价值比得分更大。",
        "伤病还是影响了轮换，主力下半场明显跑不动。",
        "哈哈最后那个边线球战术太抽象了，完全没人接球。",
        "别急着分锅，系列赛还没结束，下一场看调整。",
        "补充一下，主队最后五分钟只出现一次失误。",
    ],
    "football": [
        "主队高位压迫做得很好，开场二十分钟完全压住了对手。",
        "这个点球判罚争议太大，VAR 回看也没有解释清楚。",
        "边路突破和倒三角配合很流畅，进球是战术执行的结果。",
        "客队临门一脚太差，三个好机会只换来一次射正。",
        "门将今天两次神扑救命，不然上半场就失去悬念。",
        "中场下半场完全失控，拿不住球也组织不起反击。",
        "教练换人太晚，体能下降后才换边锋已经来不及了。",
        "防线造越位很统一，这场零封不是运气。",
        "最后十分钟的攻防转换太精彩，世界杯就该有这种强度。",
        "别只看控球率，客队真正有威胁的进攻并不多。",
        "红牌之前比赛很均衡，判罚直接改变了走势。",
        "替补前锋上来就进球，这次换人确实立竿见影。",
        "伤停导致左路一直被针对，阵容不整影响很明显。",
        "哈哈这脚空门都能打飞，节目效果拉满。",
        "理性复盘，输球主要是防线失位，不是单个前锋的问题。",
        "补充数据：主队全场完成了十八次射门和七次射正。",
    ],
}
SCENARIOS = {
    "nba_game": {
        "topic": "马刺 vs 尼克斯 G6 赛后讨论",
        "subjects": ["文班亚马", "布伦森", "主队后场", "客队锋线", "双方替补", "两队教练"],
        "positive": [
            "{subject}末节关键球执行很稳，连续两次挡拆都找到了最合理的机会。",
            "{subject}今天防守轮转太到位，协防和护框改变了比赛走势。",
            "这场团队进攻很流畅，转移球比前几场明显更快。",
            "暂停后的联防调整有效，第三节追回分差不是偶然。",
            "替补阵容贡献了真正的比赛强度，板凳奇兵值得表扬。",
            "最后五分钟双方球星都敢承担责任，这才是季后赛。",
        ],
        "neutral": [
            "从数据看，{subject}的得分不是最高，但正负值和篮板保护很关键。",
            "这场分差主要来自二次进攻，不应该只看最后一个回合。",
            "主队上半场打得更快，客队下半场通过阵地战把节奏压了下来。",
            "系列赛打到 G6，体能和轮换长度已经比单场手感更重要。",
            "回看第三节，双方都在针对中锋换防，战术选择有迹可循。",
            "补充一下，最后五分钟两队合计只有两次失误。",
        ],
        "negative": [
            "最后两分钟裁判判罚争议太大，{subject}那次防守看回放不像犯规。",
            "主队连续丢前场篮板，防守回合做了一半等于没做。",
            "{subject}今天手感低迷还一直浪投，关键阶段球权处理不合理。",
            "教练换人太慢，明显跑不动的阵容还在场上坚持了四分钟。",
            "边线球战术完全没跑出来，暂停回来出现这种失误不能接受。",
            "伤病影响了轮换，但防守漏人和沟通问题不能全怪伤病。",
        ],
    },
    "world_cup_game": {
        "topic": "阿根廷 vs 法国 世界杯淘汰赛讨论",
        "subjects": ["阿根廷中场", "法国边锋", "主队门将", "客队中卫", "双方替补", "两队教练"],
        "positive": [
            "{subject}高位压迫执行得很统一，开场就限制了对手出球。",
            "这次边路突破后的倒三角配合很漂亮，进球来自完整的战术设计。",
            "{subject}两次关键扑救保住了比分，门将表现是胜负手。",
            "防线造越位非常整齐，零封不是靠运气。",
            "替补上场后立刻提升攻防转换速度，这次换人效果明显。",
            "淘汰赛能踢出这种对攻节奏，比赛观赏性拉满。",
        ],
        "neutral": [
            "从射门分布看，{subject}控球更多，但真正进入禁区的机会并不多。",
            "上半场主队强调传控，下半场客队通过边路速度改变了局面。",
            "不要只看控球率，二点球和反击质量更能说明比赛走势。",
            "淘汰赛阶段体能分配很重要，双方最后二十分钟都主动降速。",
            "复盘这个丢球，问题从中场失位开始，不只是中卫一人的责任。",
            "补充数据：双方射正次数接近，门将处理拉开了差距。",
        ],
        "negative": [
            "这个点球判罚争议很大，VAR 回看没有消除球迷疑问。",
            "{subject}临门一脚太差，连续浪费两次单刀机会。",
            "防线回传失误太致命，淘汰赛不能给对手这种机会。",
            "中场下半场完全失控，拿不住球也组织不起有效反击。",
            "教练调整太晚，边路已经被打穿才想起换人。",
            "伤停确实影响阵容，但定位球漏人还是基本沟通问题。",
        ],
    },
}
TAILS = [
    "我更看重完整比赛过程。",
    "高赞不一定代表全部球迷。",
    "等官方数据和回放再判断。",
    "这一点在赛后讨论里分歧很大。",
    "别只用一个回合给整场表现下结论。",
]
DEMO_CLOCK = datetime(2026, 6, 25, 12, tzinfo=timezone.utc)
# End of fixed values.


def _pick(items: list[str], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(place, F.lit(len(items))) + 1).cast("int"))


def _hash(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def _iso(stamp: Column) -> Column:
    return F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def comments(spark: SparkSession, sport: str = "basketball", count: int = 16, platform: str = PLATFORM, topic: str = "", task: str = "0", board: str = "", now: datetime | None = None) -> DataFrame:
    """``count`` comments; beyond the sentences they repeat, with their number behind."""
    return comments_for(spark.range(1, count + 1).select(F.col("id").alias("number")), sport, platform, topic, task, board, now)


def comments_for(numbers: DataFrame, sport: str = "basketball", platform: str = PLATFORM, topic: str = "", task: str = "0", board: str = "", now: datetime | None = None) -> DataFrame:
    """A comment for every ``number`` of a table, from 1 on."""
    lines = SENTENCES.get(sport, SENTENCES["basketball"])
    i, clock = F.col("number"), F.lit(now) if now else F.current_timestamp()
    title = topic or NO_TITLE
    return numbers.select(
        (i - 1).alias("seq"),
        F.concat(F.lit(f"mock-{platform}-{task}-"), i).alias("id"),
        F.lit(platform).alias("platform"),
        F.lit(title).alias("topic"),
        F.concat(_pick(lines, i - 1), F.when(i > len(lines), F.concat(F.lit(" 第"), i, F.lit("条"))).otherwise("")).alias("content"),
        _hash(F.concat(F.lit(f"{platform}-"), i)).alias("author_hash"),
        (8 + 7 * i).cast("int").alias("like_count"),
        (i % 5).cast("int").alias("reply_count"),
        _iso(clock - F.make_dt_interval(mins=(11 * i).cast("int"))).alias("publish_time"),
        F.concat(F.lit(f"https://example.com/{platform}/mock-{platform}-{task}-"), i).alias("source_url"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit(title).alias("thread_title"),
        F.lit(EXCERPT).alias("thread_excerpt"),
        F.lit(board).alias("board"),
    )


def demo(spark: SparkSession, scenario: str = "nba_game", count: int = 320) -> DataFrame:
    """A scenario's comments: subject, sentence, mood and ending follow from a comment's number, so many repeat."""
    return demo_for(spark.range(count).select(F.col("id").alias("seq")), scenario)


def demo_for(numbers: DataFrame, scenario: str = "nba_game") -> DataFrame:
    """A scenario's comment for every ``seq`` of a table, from 0 on."""
    told = SCENARIOS[scenario]
    i = F.col("seq")
    moods = ("positive", "neutral", "negative")
    mood = F.pmod(i * 5 + F.floor(i / 13), F.lit(3))
    line = i * 11 + F.floor(i / 5)
    sentence = F.when(mood == 0, _pick(told[moods[0]], line)).when(mood == 1, _pick(told[moods[1]], line)).otherwise(_pick(told[moods[2]], line))
    subject = _pick(told["subjects"], i * 7 + F.floor(i / 9))
    own = F.format_string(f"{scenario}-%04d", i + 1)
    return numbers.select(
        "seq",
        own.alias("id"),
        F.lit(PLATFORM).alias("platform"),
        F.lit(told["topic"]).alias("topic"),
        F.concat_ws(" ", F.replace(sentence, F.lit("{subject}"), subject), _pick(TAILS, i * 3 + F.floor(i / 17))).alias("content"),
        _hash(F.concat(F.lit(f"{scenario}:{PLATFORM}:"), i)).alias("author_hash"),
        F.pmod(i * 37 + F.floor(i / 7) * 11, F.lit(900)).cast("int").alias("like_count"),
        F.pmod(i * 13 + F.floor(i / 19), F.lit(80)).cast("int").alias("reply_count"),
        _iso(F.lit(DEMO_CLOCK) - F.make_dt_interval(mins=(7 * i).cast("int"))).alias("publish_time"),
        F.concat(F.lit(f"https://example.com/demo/{PLATFORM}/{scenario}/"), own).alias("source_url"),
        F.lit(None).cast("string").alias("parent_id"),
    )
