"""Declared schemas of the record kinds."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _s(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


MESSAGE = _s(role=StringType(), content=StringType())
PRETRAIN = _s(text=StringType(), question=StringType(), uniqueKey=StringType())
LONG_CONTEXT = _s(TXT=StringType(), QUESTION=LongType(), SCORE=DoubleType(), SRC=StringType(), HASH=StringType())
SFT = _s(TXT=StringType(), dataset=StringType(), split=StringType(), length=LongType(), has_cot=BooleanType(), cot_length=LongType(), answer_tokens=LongType())
CHAT = _s(messages=ArrayType(MESSAGE), prompt_id=StringType())
WEB = _s(text=StringType(), id=StringType(), dump=StringType(), url=StringType(), file_path=StringType(), language=StringType(), language_score=DoubleType(), token_count=LongType(), score=DoubleType(), int_score=LongType())
PACKED = _s(index=LongType(), image_file=ArrayType(StringType()), dataset=StringType(), lang=StringType(), has_cot=BooleanType(), split=StringType(), vision_meta=StringType(), input_ids=ArrayType(IntegerType()), input_len=IntegerType(), target_mask=ArrayType(IntegerType()))
