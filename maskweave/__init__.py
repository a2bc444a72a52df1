"""maskweave: find, pseudonymise and restore personal data with Spark DataFrames.

The core covers detection, entity building, placeholder mapping, rewriting,
restoring, verification, risk and tables.  The optional subpackage ``llm``
holds operators for preparing training data; nothing here imports it.
"""

__version__ = "0.1.0"
