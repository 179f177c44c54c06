"""creditweave: applicant-level credit-risk analytics as Spark DataFrame plans."""
