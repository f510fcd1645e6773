"""Where documents come from, which grammar they are matched under, and the texts that results are written as."""
