"""Checks of uploads and options, each giving the first error that applies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# What uploads may be.
EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png")
KINDS = ("transcript", "contract")
MIME_TYPES = ("application/pdf", "image/jpeg", "image/png", "image/jpg")
ANALYZE_BYTES, DOCUMENT_BYTES = 20 * 1024 * 1024, 10 * 1024 * 1024
FOLDERS = {"transcript": "uploads/ocr_transcripts", "contract": "uploads/ocr_contracts"}
OTHER_FOLDER = "uploads/ocr_others"
# Phrases of a refusal, in answers of fewer than 100 characters.
REFUSALS = ("i'm sorry", "i can't assist", "i cannot assist", "i'm unable to", "i cannot help", "i can't help", "i'm not able to", "i cannot process", "抱歉", "無法協助", "無法處理", "不能協助", "無法提供", "我無法", "不能處理")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def upload_error(name: Column, kind: Column, size: Column, most: int = ANALYZE_BYTES) -> Column:
    """UNSUPPORTED_FILE_TYPE, UNSUPPORTED_DOCUMENT_TYPE or FILE_TOO_LARGE, the first that applies; null if none does."""
    return (
        F.when(~F.coalesce(extension(name), F.lit("")).isin(*EXTENSIONS), "UNSUPPORTED_FILE_TYPE")
        .when(~F.coalesce(kind, F.lit("")).isin(*KINDS), "UNSUPPORTED_DOCUMENT_TYPE")
        .when(size > most, "FILE_TOO_LARGE")
    )


def status_code(error: Column) -> Column:
    return F.when(error == "FILE_TOO_LARGE", 413).when(error.isNotNull(), 400).otherwise(200)


def document_error(mime: Column, size: Column) -> Column:
    return F.when(~F.coalesce(mime, F.lit("")).isin(*MIME_TYPES), "UNSUPPORTED_FILE_TYPE").when(size > DOCUMENT_BYTES, "FILE_TOO_LARGE")


def folder(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, kind), F.lit(OTHER_FOLDER))


def chat_error(document_id: Column, status: Column, text_id: Column) -> Column:
    """Why a document can't be asked about yet: it is absent, not completed, or has no recognised text."""
    return F.when(document_id.isNull(), "NOT_FOUND").when(F.coalesce(status, F.lit("")) != "completed", "NOT_READY").when(text_id.isNull(), "NO_TEXT")


def is_refusal(answer: Column) -> Column:
    low, found = F.lower(answer), F.lit(False)
    for phrase in REFUSALS:
        found = found | F.contains(low, F.lit(phrase))
    return (F.length(answer) < 100) & found


def band(value: Column) -> Column:
    """green from 0.7, yellow from 0.5, else red."""
    return F.when(value >= 0.7, "green").when(value >= 0.5, "yellow").otherwise("red")


@dataclass(frozen=True)
class PageOptions:
    """Options of page processing; wrong values raise ValueError."""

    quality: int = 80
    retries: int = 2
    engines: tuple[str, ...] = ("paddleocr", "tesseract")
    fusion: str = "best"
    binarization: str = "gaussian"
    dpi: int = 1500
    hue: tuple[int, int] = (0, 180)
    saturation: tuple[int, int] = (0, 255)
    value: tuple[int, int] = (0, 255)

    def __post_init__(self):
        within = lambda x, lo, hi: lo <= x <= hi
        checks = {
            "quality": within(self.quality, 0, 100), "retries": within(self.retries, 0, 10), "engines": bool(self.engines) and set(self.engines) <= {"paddleocr", "tesseract", "textract"},
            "fusion": self.fusion in ("best", "weighted", "vote"), "binarization": self.binarization in ("gaussian", "mean", "sauvola"), "dpi": within(self.dpi, 100, 3000),
            "hue": all(within(x, 0, 180) for x in self.hue), "saturation": all(within(x, 0, 255) for x in self.saturation), "value": all(within(x, 0, 255) for x in self.value),
        }
        if wrong := [k for k, ok in checks.items() if not ok]:
            raise ValueError(f"out of range: {', '.join(wrong)}")
