"""seqforge: Spark-native preparation and evaluation of text-to-sequence corpora.

Every operator is a Column -> Column or DataFrame -> DataFrame function built
from Spark SQL expressions, shuffles and windows.
"""

from seqforge.session import get_session, checkpoint_dir  # noqa: F401
