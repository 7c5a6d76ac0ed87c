"""Synthetic users and rules for tests and benchmarks."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Rule

#: The domains of the wide table's columns.
CITIES = {
    "广东": ["深圳", "广州", "东莞"],
    "江苏": ["南京", "苏州", "无锡"],
    "浙江": ["杭州", "宁波", "温州"],
    "上海": ["上海"],
    "北京": ["北京"],
    "四川": ["成都", "绵阳"],
    "山东": ["济南", "青岛"],
    "湖北": ["武汉", "宜昌"],
    "福建": ["福州", "厦门"],
    "湖南": ["长沙", "株洲"],
}
DOMAINS = {
    "gender": ["男", "女"],
    "occupation": ["程序员", "教师", "销售", "学生", "产品经理", "设计师", "医生", "律师", "自由职业", "公务员"],
    "education": ["高中", "大专", "本科", "硕士", "博士"],
    "marital_status": ["未婚", "已婚", "离异"],
    "income_level": ["<5k", "5k-10k", "10k-20k", "15k-20k", "20k-30k", "30k+"],
    "favorite_category": ["数码", "数码产品", "图书", "汽车", "美妆", "家电", "服饰", "食品", "母婴", "运动"],
    "device_type": ["iPhone", "Android", "iPad", "Windows", "Mac"],
    "os_type": ["iOS", "Android", "Windows", "macOS"],
    "browser": ["Safari", "Chrome", "Edge", "Firefox"],
    "app_version": ["8.0.0", "8.1.5", "8.2.0", "8.2.1", "9.0.0"],
    "risk_level": ["低", "中", "高"],
}
TAGS = ["高价值", "数码爱好者", "夜猫子", "亲子", "教育", "高频登录", "商务", "忠诚用户", "学生", "价格敏感", "会员", "智能家居", "高净值", "高消费"]


def users(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n users with 27 columns; the same seed gives the same rows, whatever the partitions are."""
    salt = iter(range(1000))

    def draw() -> Column:
        """Uniform in [0, 1), from a hash of the row's number."""
        return F.pmod(F.xxhash64("uid", F.lit(seed), F.lit(next(salt))), F.lit(1 << 40)).cast("double") / float(1 << 40)

    def below(k: int) -> Column:
        return F.floor(draw() * k).cast("int")

    def pick(values: list[str]) -> Column:
        return F.get(F.array(*map(F.lit, values)), below(len(values)))

    def cents(x: Column) -> Column:
        return (x * 100 + 0.5).cast("long").cast("double") / 100

    base = spark.range(1, n + 1).withColumnRenamed("id", "uid").withColumn("province", pick(list(CITIES)))
    place = draw()
    city = F.coalesce(*(F.when(F.col("province") == p, F.get(F.array(*map(F.lit, c)), F.floor(place * len(c)).cast("int"))) for p, c in CITIES.items()))
    base = base.withColumn("order_count", below(400)).withColumn("average", 50 + draw() * 500)
    numbers = {"age": 18 + below(50), "vip_level": below(6), "register_days": below(2000), "login_days_30d": below(31), "credit_score": 400 + below(450), "active_score": cents(draw() * 100)}
    columns = {"username": F.concat(F.lit("user"), F.lpad(F.col("uid").cast("string"), 6, "0")), "city": city, "total_amount": cents(F.col("order_count") * F.col("average")), "avg_order_amount": cents(F.col("average"))}
    columns |= numbers | {k: pick(v) for k, v in DOMAINS.items()} | {f"tag{i}": pick(TAGS) for i in (1, 2, 3)}
    return base.select("uid", "province", "order_count", *(c.alias(k) for k, c in columns.items()))


def _texts(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def rules(n: int, seed: int = 42) -> list[Rule]:
    """n conjunctions of two to five predicates on different fields."""
    rng = random.Random(seed)

    def age() -> str:
        low = rng.randrange(18, 48)
        return f"age BETWEEN {low} AND {low + rng.randrange(5, 25)}"

    predicates = {
        "age": age,
        "province": lambda: f"province IN ({_texts(rng.sample(list(CITIES), rng.randint(1, 3)))})",
        "income_level": lambda: f"income_level IN ({_texts(rng.sample(DOMAINS['income_level'], rng.randint(1, 3)))})",
        "favorite_category": lambda: "favorite_category LIKE '数%'",
        "active_score": lambda: f"active_score >= {rng.randrange(50, 100)}",
        "vip_level": lambda: f"vip_level >= {rng.randint(1, 4)}",
        "gender": lambda: f"gender = '{rng.choice(DOMAINS['gender'])}'",
        "total_amount": lambda: f"total_amount > {1000 * rng.randrange(60)}",
        "login_days_30d": lambda: f"login_days_30d >= {rng.randrange(25)}",
        "risk_level": lambda: f"risk_level = '{rng.choice(DOMAINS['risk_level'])}'",
        "credit_score": lambda: f"credit_score < {rng.randrange(500, 850)}",
    }
    return [Rule(10000 + i, f"rule_{i:05d}", " AND ".join(predicates[f]() for f in rng.sample(list(predicates), rng.randint(2, 5))), rng.randrange(20)) for i in range(n)]
