"""Part of latticework."""
