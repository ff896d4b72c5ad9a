"""Query texts by operator family: name -> SQL with the placeholders of ``fathom.functions``."""
