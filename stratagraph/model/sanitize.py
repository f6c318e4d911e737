"""Credentials in URLs, masked before anything is stored."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands before @github.com in a URL or token prefix, and the mask (fixed values).
CREDENTIAL = r"(?i)(?:https?://|x-ac{1,2}ess-token:)[^@/ ]*@github\.com"
MASK = "x-access-token:*@github.com"


def sanitize(text: Column) -> Column:
    """The text with credentials masked; null stays null."""
    return F.regexp_replace(text, CREDENTIAL, MASK)


def sanitize_map(attributes: Column) -> Column:
    """The same for every value of an attribute map; nested values are JSON text and masked inside it."""
    return F.transform_values(attributes, lambda _, v: sanitize(v))
