"""tabloom functions."""
