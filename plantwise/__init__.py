"""plantwise: plant-effectiveness and technical-text analytics as Spark DataFrame functions.

Every public operator is a plain ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function built from Spark's own expressions, so Catalyst sees the whole plan.
"""

from plantwise.session import ensure_checkpoint_dir, get_session

__all__ = ["get_session", "ensure_checkpoint_dir"]
