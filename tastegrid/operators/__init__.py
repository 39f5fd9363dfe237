"""DataFrame operators: every public function takes and returns DataFrames."""
