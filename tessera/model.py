"""Schemas, query parameters and their validation."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import types as T

#: Points with names only; with keywords; with keywords and a score.
NAMED_POINTS = T.StructType([T.StructField("lon", T.FloatType()), T.StructField("lat", T.FloatType()), T.StructField("name1", T.StringType()), T.StructField("name2", T.StringType())])
KEYWORD_POINTS = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()), T.StructField("keywords", T.StringType())])
SCORED_POINTS = T.StructType([*KEYWORD_POINTS.fields, T.StructField("score", T.DoubleType())])
RESULT = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()), T.StructField("score", T.DoubleType())])

#: Numbers and names of the strategies; several numbers are one plan here, since all are exact but the two last.
STRATEGIES = {0: "multi_round", 1: "single_round", 2: "hybrid", 3: "single_round", 4: "hybrid", 5: "single_round", 6: "hybrid", 7: "hybrid", 8: "approximate", 9: "uniform"}
#: What a region's score is: the weights' sum, the number of points, or the number of distinct keywords.
SCORES = ("sum", "count", "distinct_keywords")
ALIASES = {"unif": "uniform", "single": "single_round", "multi": "multi_round", "app": "approximate"}


class InvalidQuery(ValueError):
    """A parameter is missing or out of range."""


def absent(value: str | None) -> bool:
    """None, empty and the word null all mean that a column or filter isn't used."""
    return value is None or value == "" or value == "null"


def strategy_name(algo: int | str) -> str:
    name = STRATEGIES.get(algo) if isinstance(algo, int) else ALIASES.get(algo, algo)
    if name not in STRATEGIES.values():
        raise InvalidQuery(f"unknown strategy {algo!r}")
    return name


@dataclass(frozen=True)
class RegionQuery:
    """The k best eps-by-eps squares over the points of a table."""

    topk: int
    eps: float
    f: str | None = None
    dist: bool = True
    input: str = ""
    keywords_column: str | None = None
    keywords: str | None = None
    keywords_column2: str | None = None
    keywords2: str | None = None
    algo: int | str = 2
    partitions: int = 100
    base: int = 16
    kprime: int = 5
    sigma: float = 0.9
    bbox: tuple[float, float, float, float] | None = None
    score: str = "sum"

    def __post_init__(self):
        for name in ("topk", "eps", "partitions", "base", "kprime"):
            if not getattr(self, name) > 0:
                raise InvalidQuery(f"{name} must be positive")
        if not 0 < self.sigma <= 1:
            raise InvalidQuery("sigma must be over 0 and at most 1")
        strategy_name(self.algo)
        if self.score not in SCORES:
            raise InvalidQuery(f"unknown score {self.score!r}")
        if self.score == "distinct_keywords" and absent(self.keywords_column):
            raise InvalidQuery("distinct_keywords needs a keywords column")

    def key(self) -> tuple:
        """What makes two queries the same; dist and strategy are part of it."""
        return tuple(None if isinstance(v, str) and absent(v) else v for v in asdict(self).values())

    @classmethod
    def from_parameters(cls, given: dict) -> RegionQuery:
        """From strings, as a request has them; unknown names are ignored."""
        names = {"keywordsColumn": "keywords_column", "keywordsColumn2": "keywords_column2", "partitionsCNT": "partitions", "Kprime": "kprime", "table": "input"}
        kinds, found = {f.name: str(f.type) for f in fields(cls)}, {"topk": 0, "eps": 0.0}
        for k, v in given.items():
            name = names.get(k, k)
            if name not in kinds or v is None:
                continue
            try:
                found[name] = int(v) if kinds[name] == "int" else float(v) if kinds[name] == "float" else str(v).lower() in ("true", "1") if kinds[name] == "bool" else int(v) if name == "algo" and str(v).isdigit() else v
            except ValueError as e:
                raise InvalidQuery(f"{k}: {e}") from e
        return cls(**found)


@dataclass
class EngineConf:
    """Settings of the service."""

    jdbc_url: str = ""
    user: str = ""
    password: str = ""
    extracts: str = "extracts"
    results: str = "results.jsonl"
    host: str = "127.0.0.1"
    port: int = 9090
    algo: int | str = 2
    partitions: int = 100
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> EngineConf:
        """From a strict JSON object; other keys go to ``extra``."""
        import json

        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        known = {f.name for f in fields(cls)} - {"extra"}
        return cls(**{k: v for k, v in given.items() if k in known}, extra={k: v for k, v in given.items() if k not in known})
