"""kestrel: online learning and evaluation of labelled text records on Spark.

Sub-packages:

* ``sources``   - tables, CSV/JSON ingest, keyed messages, model store
* ``functions`` - column expressions (cleaning, arrays, label books)
* ``operators`` - DataFrame operators (metrics, sequences, registry, heads)
* ``streaming`` - Structured Streaming jobs built from the operators
* ``plans``     - stand-in fixtures over the driver tables and the query catalogue
"""

from kestrel.session import build_session, checkpoint_dir, ensure_checkpoint_dir

__all__ = ["build_session", "checkpoint_dir", "ensure_checkpoint_dir"]
