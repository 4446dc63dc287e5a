"""Seed hashtags for collecting control posts from a stored posts table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finchlab.functions import text as X
from finchlab.operators.lists import exploded
from finchlab.operators.ranking import newest_per_group

# fixed values: seed hashtag and row cap; the empty seed takes any post
TOP_HASHTAGS = """
MAGA 7000
top 6500
mar 4700
PJNET 4700
FAKENEWS 4300
tcot 4000
IslamKills 3900
topl 3800
amb 2800
DemnDebate 2400
GOPDebate 2400
th 2200
may 2100
DemDebate 2100
VegasGOPDebate 2000
WakeUpAmerica 2000
Brussels 2000
2A 2000
jud 2000
ccot 2000
TrumpForPresident 1600
StopIslam 1600
USFA 1600
imo 1600
Trump 1600
TrumpTrain 1600
TrumpBecause 1600
vvmar 1600
marv 1600
Trump2016 1600
ells 1600
ella 1600
law 1600
laww 1600
dannis 1600
danita 1600
job 1600
Prayers4California 1600
jobb 1200
just 1200
iva 1200
iv 1200
eevan 1200
evas 1200
MakeAmericaGreatAgain 1200
arre 1200
ara 1200
Charlottesville 1200
jan 1200
"""
CAPITALISED_HASHTAGS = """
StopTheGOP 1200
Obama 1200
CruzCrew 1200
ISIS 1200
DrainTheSwamp 1200
FeelTheBern 1200
ABCGOPDebate 1200
ABCNews 1200
HillaryForPrison2016 1200
PrayForBrussels 1200
CorruptCongress 1200
Guns4NY 1200
BeingPatriotic 1200
NRA 1200
NeverHillary 1200
TedCruz 1200
LiberalLogic 1200
Antifa 1200
NoCyberCensorship 1200
Ame 1200
ABISS 1200
Hillary 1200
AltLeft 1200
Texas 1200
"""
ANY_POST_CAP = 100000
SINCE, UNTIL = "2015-01-01", "2018-01-01"


def default_seeds() -> list[tuple[str, int]]:
    lines = (TOP_HASHTAGS + CAPITALISED_HASHTAGS).split("\n")
    pairs = [line.split() for line in lines if line]
    return [("#" + tag, int(cap)) for tag, cap in pairs] + [("", ANY_POST_CAP)]


def collect_by_seed(
    posts: DataFrame,
    seeds: list[tuple[str, int]],
    key: str = "post_id",
    since: str = SINCE,
    until: str = UNTIL,
    language: str = "English",
    verified: str | None = None,
) -> DataFrame:
    """Newest posts per seed hashtag up to the seed's cap: (seed, key, rank).

    Hashtags match without regard to case. Ranking only moves the key and the
    date, and of a seed that matches a third of all posts only the newest rows up
    to its own cap are ranked.
    """
    wanted = posts.filter(
        (F.col("publish_date") >= F.lit(since).cast("timestamp_ntz"))
        & (F.col("publish_date") < F.lit(until).cast("timestamp_ntz"))
        & (F.col("language") == language)
        & (F.col("retweet") == 0)
        & ~F.col("content").startswith("RT ")
    )
    if verified:
        wanted = wanted.filter(F.col(verified))
    tags = F.array_distinct(F.transform(X.hashtags(F.col("content")), F.lower))
    tagged = exploded(
        wanted, F.array_append(tags, F.lit("")), "_tag", [key, "publish_date"]
    )
    table = posts.sparkSession.createDataFrame(
        [(seed, seed.lower(), cap) for seed, cap in seeds], "seed string, _tag string, cap int"
    )
    hits = tagged.join(table, "_tag")
    return newest_per_group(hits, "seed", "publish_date", key, "cap").select("seed", key, "rank")


def collected_posts(
    posts: DataFrame, picks: DataFrame, seeds: list[tuple[str, int]], key: str = "post_id"
) -> DataFrame:
    """Whole posts of `collect_by_seed`, with seed and rank; one row per seed and post."""
    return posts.join(picks, key).select(*posts.columns, "seed", "rank")
