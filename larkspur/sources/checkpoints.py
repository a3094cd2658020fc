"""Checkpoints of fitted models: a model's files with a receipt of them, checked before the model is read again."""

from __future__ import annotations

from pyspark.sql import SparkSession

from larkspur.sources.bundles import check_receipt, exists, write_receipt


def save(spark: SparkSession, model, path: str, contract: dict) -> dict:
    """Write a model with its receipt; an existing checkpoint is an error."""
    if exists(spark, path):
        raise FileExistsError(path)
    model.write().save(f"{path}/model")
    return write_receipt(spark, path, contract)


def load(spark: SparkSession, kind, path: str, contract: dict):
    """The model of a checkpoint; files that aren't as their receipt says, or another contract, are an error."""
    check_receipt(spark, path, contract)
    return kind.load(f"{path}/model")
