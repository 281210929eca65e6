"""Links of works and episodes. Nothing is escaped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinkConfig:
    # Defaults of the deployment settings.
    storage: str = "local"
    cdn_domain: str = ""
    videos_prefix: str = "processed_videos/"
    subtitles_prefix: str = "source_subtitles/"
    local_base: str = "http://localhost:9999"
    local_media: str = "/media/"
    labelling_base: str = "http://localhost:8081"
    editor_base: str = "http://localhost:3000"


def _root(config: LinkConfig, cdn_prefix: str, local_folder: str) -> str:
    if config.storage == "s3":
        return f"https://{config.cdn_domain}/{cdn_prefix}"
    return f"{config.local_base}{config.local_media}{local_folder}"


def video_url(asset_id: Column, config: LinkConfig = LinkConfig()) -> Column:
    return F.concat(F.lit(_root(config, config.videos_prefix, "processed_videos/")), asset_id, F.lit(".mp4"))


def subtitle_url(asset_id: Column, name: Column, config: LinkConfig = LinkConfig()) -> Column:
    """Null where the subtitle file is missing."""
    root = _root(config, config.subtitles_prefix, "source_subtitles/")
    return F.concat(F.lit(root), asset_id, F.lit("/"), name)


def editor_url(asset_id: Column, video: Column, subtitle: Column, config: LinkConfig = LinkConfig()) -> Column:
    """Only for an episode with both a video and a subtitle link."""
    link = F.concat(F.lit(config.editor_base + "?videoUrl="), video, F.lit("&srtUrl="), subtitle,
                    F.lit("&assetId="), asset_id.cast("string"))
    return F.when(_given(video) & _given(subtitle), link)


def project_url(project_id: Column, config: LinkConfig = LinkConfig()) -> Column:
    link = F.concat(F.lit(config.labelling_base + "/projects/"), project_id.cast("string"))
    return F.when(_given_id(project_id), link)


def task_url(project_id: Column, task_id: Column, config: LinkConfig = LinkConfig()) -> Column:
    task = task_id.cast("string")
    link = F.concat(F.lit(config.labelling_base + "/projects/"), project_id.cast("string"),
                    F.lit("/data?tab="), task, F.lit("&task="), task)
    return F.when(_given_id(project_id) & _given_id(task_id), link)


def _given(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _given_id(number: Column) -> Column:
    return F.coalesce(number, F.lit(0)) != 0
