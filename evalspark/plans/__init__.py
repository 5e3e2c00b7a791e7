"""End-to-end plans and the query catalogue (``catalog``) with its SQL oracle (``oracle``)."""
