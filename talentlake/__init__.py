"""talentlake: job-postings analytics as Spark DataFrame plans.

    from talentlake.functions import text, salary, coerce      # Column -> Column rules
    from talentlake.operators import dedup, quality, salary, bi, similarity
    from talentlake.sources import connectors, landing, keyed_table
    from talentlake.plans.stages import merge_stage, transform_stage
    from talentlake.plans.pipeline import run_daily
    from talentlake.streaming.ingest import start_ingest
"""

from .plans.pipeline import run_daily  # noqa: F401
from .plans.stages import enrich, merge_stage, transform_stage  # noqa: F401
from .session import get_spark  # noqa: F401
