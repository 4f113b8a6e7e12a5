"""All registered queries with their SQL."""

from . import fits, models, records, responses, signals

QUERIES = {**responses.QUERIES, **models.QUERIES, **records.QUERIES, **fits.QUERIES, **signals.QUERIES}
