"""python -m lobspark [--config PROFILE] upload-once [--date YYYY-MM-DD | --today | --yesterday] | maintain | collect FOLDER"""

from __future__ import annotations

import argparse
import os
from datetime import UTC, date, datetime, timedelta

from lobspark.config import Settings


def arguments(argv: list[str] | None = None, today: date | None = None) -> argparse.Namespace:
    today = today or datetime.now(UTC).date()
    top = argparse.ArgumentParser(prog="lobspark")
    top.add_argument("--config", help="profile file of KEY=VALUE lines; the environment otherwise")
    jobs = top.add_subparsers(dest="job", required=True)
    once = jobs.add_parser("upload-once", help="send one day to the object store")
    day = once.add_mutually_exclusive_group()
    day.add_argument("--date", dest="day", type=date.fromisoformat, default=today)
    day.add_argument("--today", dest="day", action="store_const", const=today)
    day.add_argument("--yesterday", dest="day", action="store_const", const=today - timedelta(days=1))
    jobs.add_parser("maintain", help="send the day before after every UTC midnight and apply retention")
    live = jobs.add_parser("collect", help="land the live feed's frames as files, reconnecting for ever")
    live.add_argument("folder")
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    asked = arguments(argv)
    settings = Settings.from_file(asked.config) if asked.config else Settings.from_env(os.environ)
    if asked.job == "collect":  # needs no Spark
        from lobspark.sources import live

        live.run(settings, asked.folder)
        return
    from pyspark.sql import SparkSession

    from lobspark.sources import daily

    spark = SparkSession.builder.appName("lobspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if asked.job == "upload-once":
        print(daily.run_day(spark, settings, asked.day))
    else:
        daily.maintain(spark, settings)


if __name__ == "__main__":
    main()
