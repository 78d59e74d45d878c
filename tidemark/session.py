"""Session and settings."""

from __future__ import annotations

import json
import logging.config
import os
from dataclasses import dataclass, field, fields, replace
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession

#: The settings that apply where no other file is named.
DEFAULTS = Path(__file__).with_name("settings.json")
#: Names another settings file.
FILE_VARIABLE = "TIDEMARK_SETTINGS"

#: Fixed names: environment variables that override a setting.
VARIABLES = {
    "app_name": "SPARK_APP_NAME", "catalog": "ICEBERG_CATALOG_NAME", "warehouse": "ICEBERG_WAREHOUSE", "checkpoints": "SPARK_CHECKPOINT_BASE",
    "brokers": "KAFKA_BOOTSTRAP_SERVERS", "starting_offsets": "KAFKA_STARTING_OFFSETS", "fail_on_data_loss": "KAFKA_FAIL_ON_DATA_LOSS",
    "s3_endpoint": "S3_ENDPOINT", "s3_access_key": "S3_ACCESS_KEY", "s3_secret_key": "S3_SECRET_KEY", "s3_path_style": "S3_PATH_STYLE_ACCESS", "s3_ssl": "S3_SSL_ENABLED",
    "db_host": "POSTGRES_HOST", "db_port": "POSTGRES_INTERNAL_PORT", "db_name": "POSTGRES_DB", "db_user": "POSTGRES_USER", "db_password": "POSTGRES_PASSWORD",
}


@dataclass(frozen=True)
class Settings:
    """Defaults, overridden by a JSON file, overridden by the environment."""

    app_name: str = "tidemark"
    catalog: str = "lakehouse"
    warehouse: str = "warehouse"
    checkpoints: str = "checkpoints"
    brokers: str = "localhost:9092"
    starting_offsets: str = "earliest"
    fail_on_data_loss: bool = False
    topics: list[str] = field(default_factory=list)
    s3_endpoint: str = ""
    s3_access_key: str = ""
    s3_secret_key: str = ""
    s3_path_style: bool = True
    s3_ssl: bool = False
    db_host: str = "postgres"
    db_port: int = 5432
    db_name: str = ""
    db_user: str = ""
    db_password: str = ""

    def under(self, base: str, *names: str) -> str:
        return "/".join([base.rstrip("/"), *(n.strip("/") for n in names)])

    @property
    def tables(self) -> str:
        """The folder of the catalog's tables."""
        return self.under(self.warehouse, self.catalog)

    @property
    def jdbc(self) -> dict[str, str]:
        return {"url": f"jdbc:postgresql://{self.db_host}:{self.db_port}/{self.db_name}", "user": self.db_user, "password": self.db_password, "driver": "org.postgresql.Driver"}


def _read(kind: str, value):
    """A value of a file or the environment as its setting's type."""
    match kind, value:
        case "bool", str():
            return value.strip().lower() in {"1", "true", "yes", "y"}
        case "int", _:
            return int(value)
        case "list[str]", str():
            return [part.strip() for part in value.split(",") if part.strip()]
        case _:
            return value


def settings(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """The file is ``path``, or what FILE_VARIABLE names, or DEFAULTS."""
    env = os.environ if env is None else env
    given = json.loads(Path(path or env.get(FILE_VARIABLE) or DEFAULTS).read_text())
    kinds = {f.name: f.type for f in fields(Settings)}
    if unknown := given.keys() - kinds.keys():
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    given |= {name: env[variable] for name, variable in VARIABLES.items() if variable in env}
    return replace(Settings(), **{name: _read(kinds[name], value) for name, value in given.items()})


def session(conf: Settings | None = None, suffix: str = "", **more: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution; object-store options only where set."""
    conf = conf or Settings()
    builder = SparkSession.builder.appName(f"{conf.app_name}-{suffix}" if suffix else conf.app_name)
    options = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    if conf.s3_endpoint:
        options |= {
            "spark.hadoop.fs.s3a.endpoint": conf.s3_endpoint, "spark.hadoop.fs.s3a.access.key": conf.s3_access_key, "spark.hadoop.fs.s3a.secret.key": conf.s3_secret_key,
            "spark.hadoop.fs.s3a.path.style.access": str(conf.s3_path_style).lower(), "spark.hadoop.fs.s3a.connection.ssl.enabled": str(conf.s3_ssl).lower(),
        }
    return builder.config(map=options | more).getOrCreate()


@cache
def _logging() -> None:
    """Once per process: everything under `tidemark` goes to standard output."""
    logging.config.dictConfig({
        "version": 1, "disable_existing_loggers": False, "formatters": {"line": {"format": "%(asctime)s %(levelname)s %(name)s %(message)s"}},
        "handlers": {"out": {"class": "logging.StreamHandler", "stream": "ext://sys.stdout", "formatter": "line"}},
        "loggers": {"tidemark": {"handlers": ["out"], "level": "INFO", "propagate": False}},
    })


def logger(name: str) -> logging.Logger:
    _logging()
    return logging.getLogger("tidemark").getChild(name)
