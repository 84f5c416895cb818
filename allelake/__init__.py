"""Variant association analysis on Spark: sources, relational and statistical operators, and resumable runs."""

from allelake.schemas import AssociationMode, BinaryCorrection, Device, GenotypeFormat, TraitType

__all__ = ["AssociationMode", "BinaryCorrection", "Device", "GenotypeFormat", "TraitType"]
