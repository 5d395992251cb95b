"""Table-in / table-out operators.  Each is a ``DataFrame -> DataFrame``
function usable with ``DataFrame.transform``."""
